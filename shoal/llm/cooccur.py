"""Pairs of items on the same basket, counted by stripes and weighed by the log-likelihood ratio.

Each task keeps, per item, an associative array of the items met beside it and merges baskets into it; only
the merged arrays are handed on. Arrays of one item are merged entry by entry: entries add up in each task before
the shuffle and are spread by (item, neighbour), so an item with very many stripes is no hot key. A basket
with very many items is cut by its first item of a pair. Items are numbered, so arrays hold numbers.
Items that can be in no reported pair are dropped first, by exact bounds:

* a pair is on no more baskets than its rarer item, so both items need the pair's least support;
* a pair exceeds chance by a factor of at most baskets / (baskets of its commoner item).

What is left is judged by Dunning's log-likelihood ratio G2 against independence: a pair comes out only if its G2
reaches ``min_llr`` (chi-square with one degree of freedom: 3.84 is a risk of 5 %, 6.63 of 1 %, 10.83 of 0.1 %).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.session import materialized

#: Entries a task holds before it hands its stripes on.
HOLD = 1_000_000
#: First items of pairs a row takes of a basket; a larger basket is cut.
ANCHORS = 512
#: chi-square with one degree of freedom, exceeded by chance at 5 %, 1 % and 0.1 %: fixed values.
LLR_5, LLR_1, LLR_01 = 3.841459, 6.634897, 10.827566
_STRIPE = "item long, neighbours array<long>, counts array<int>"


def _stripes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[int, Counter] = defaultdict(Counter)
    added = 0

    def hand_on() -> pd.DataFrame:
        rows = [(a, list(c.keys()), list(c.values())) for a, c in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["item", "neighbours", "counts"])

    for pdf in batches:
        for b, lo in zip(pdf["items"], pdf["lo"]):
            b = b.tolist()
            for i in range(lo, min(lo + ANCHORS, len(b) - 1)):
                held[b[i]].update(b[i + 1 :])
                added += len(b) - i - 1
                # a bound on the entries, without walking over the stripes
                if added >= HOLD:
                    if sum(map(len, held.values())) >= HOLD:
                        yield hand_on()
                    added = 0
    if held:
        yield hand_on()


def item_pairs(rows: DataFrame, basket: str, item: str, min_count: int = 1, min_share: float = 0.0, min_lift: float = 0.0, min_llr: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, llr) of each pair, item_a < item_b, that meets the four bounds.

    n_ab, n_a and n_b count baskets, n all baskets; lift is n_ab * n / (n_a * n_b); llr is the
    log-likelihood ratio against independence, negative for pairs rarer than by chance. min_share is a pair's least share of all
    baskets, min_llr the least size of llr, either way. An item counts once a basket; rows with a null basket or item
    don't count. An empty table gives no rows.
    """
    base = materialized(
        rows.select(F.col(basket).cast("string").alias("basket"), F.col(item).cast("string").alias("item")).filter("basket IS NOT NULL AND item IS NOT NULL").distinct(),
        "baskets",
    )
    n = base.agg(F.count_distinct("basket").alias("n"))
    counts = base.groupBy("item").agg(F.count("*").alias("n_i")).crossJoin(F.broadcast(n))
    kept = counts.filter((F.col("n_i") >= min_count) & (F.col("n_i") >= F.col("n") * min_share * (1 - 1e-12)) & (F.col("n") >= F.col("n_i") * min_lift))
    # small numbers: the place in the partition, then the partition; written, as the stripes and the reported pairs need them
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = materialized(kept.withColumn("k", place * tasks + F.spark_partition_id()), "items")
    # a basket holds an item once: its list is bounded by the number of kept items
    baskets = base.join(kept.select("item", "k"), "item").groupBy("basket").agg(F.array_sort(F.collect_list("k")).alias("items")).filter(F.size("items") > 1)
    cut = baskets.select("items", F.explode(F.sequence(F.lit(0), F.size("items") - 2, F.lit(ANCHORS))).alias("lo"))
    stripes = cut.mapInPandas(_stripes, _STRIPE)
    pairs = stripes.select("item", F.explode(F.arrays_zip("neighbours", "counts")).alias("e")).groupBy("item", F.col("e")["neighbours"].alias("other"))
    pairs = pairs.agg(F.sum(F.col("e")["counts"].cast("long")).alias("n_ab")).filter(F.col("n_ab") >= min_count)
    left = kept.select(F.col("k").alias("item"), F.struct(F.col("item").alias("i"), "n_i").alias("x"), "n")
    right = kept.select(F.col("k").alias("other"), F.struct(F.col("item").alias("i"), "n_i").alias("y"))
    a, b = F.least("x", "y"), F.greatest("x", "y")
    p = pairs.join(left, "item").join(right, "other").select("n_ab", "n", a["i"].alias("item_a"), a["n_i"].alias("n_a"), b["i"].alias("item_b"), b["n_i"].alias("n_b"))
    p = p.filter((F.col("n_ab") >= F.col("n") * min_share * (1 - 1e-12)) & (F.col("n_ab") * F.col("n") >= F.col("n_a") * F.col("n_b") * min_lift))
    k11, k12, k21 = F.col("n_ab"), F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")
    k22 = F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab")

    def xlx(x):
        return F.when(x > 0, x * F.ln(x.cast("double"))).otherwise(0.0)

    g = 2 * (
        xlx(k11) + xlx(k12) + xlx(k21) + xlx(k22) + xlx(F.col("n"))
        - xlx(F.col("n_a")) - xlx(F.col("n") - F.col("n_a")) - xlx(F.col("n_b")) - xlx(F.col("n") - F.col("n_b"))
    )
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    llr = F.greatest(g, F.lit(0.0))
    if min_llr > 0:
        p = p.filter(llr >= min_llr)
    return p.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), (llr * F.when(lift >= 1, 1).otherwise(-1)).alias("llr"))
