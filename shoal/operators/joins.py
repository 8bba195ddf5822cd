"""Joins that Spark has no single operator for."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DuplicateKeys(ValueError):
    """A side of a one-to-one join has a key more than once."""


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Inner join on keys that must be unique on both sides; other common columns get suffixes."""
    for side, name in ((left, "left"), (right, "right")):
        if side.groupBy(*on).count().filter("count > 1").limit(1).count():
            raise DuplicateKeys(f"{name} has repeated keys in {on}")
    both = [c for c in left.columns if c in right.columns and c not in on]
    lf = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    return lf.join(right.withColumnsRenamed({c: c + suffixes[1] for c in both}), on)


def event_within(rows: DataFrame, events: DataFrame, entity: str, at: str, event_at: str, horizon: int, out: str = "label") -> DataFrame:
    """out = 1 where an event of the entity lies in (at, at + horizon], else 0; at and event_at are longs.

    Time is cut into bins of the horizon: an event can only be ahead of rows of its own bin and the one
    before, so the join is on equal keys with two copies of each event, whatever their number. Rows with a null entity or time get 0.
    """
    b = F.floor(F.col("_e") / horizon)
    ev = events.select(F.col(entity), F.col(event_at).cast("long").alias("_e")).filter(F.col(entity).isNotNull() & F.col("_e").isNotNull()).distinct()
    # the next event after a time t lies in t's bin or the next, so the earliest and all of a bin are enough
    ev = ev.withColumn("_bin", F.explode(F.array(b, b - 1)))
    per_bin = ev.groupBy(entity, "_bin").agg(F.sort_array(F.collect_set("_e")).alias("_es"))
    r = rows.withColumn("_bin", F.floor(F.col(at) / horizon))
    t = F.col(at)
    hit = F.exists("_es", lambda e: (e > t) & (e <= t + horizon))
    return r.join(per_bin, [entity, "_bin"], "left").withColumn(out, F.coalesce(hit.cast("int"), F.lit(0))).select(*rows.columns, out)


def outside_periods(rows: DataFrame, periods: DataFrame, entity: str, at: str, bin_size: int) -> DataFrame:
    """Rows whose time lies in no period [start_s, end_s) of their entity; periods are disjoint.

    Periods are placed in every bin of bin_size that they touch, so the join is on equal keys.
    """
    p = periods.select(entity, "start_s", "end_s").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_s") / bin_size), F.floor((F.col("end_s") - 1) / bin_size))))
    r = rows.withColumn("_bin", F.floor(F.col(at) / bin_size))
    cond = (r[entity] == p[entity]) & (r["_bin"] == p["_bin"]) & (r[at] >= p["start_s"]) & (r[at] < p["end_s"])
    return r.join(p, cond, "left_anti").select(*rows.columns)


def expand_steps(df: DataFrame, first: str, last: str, out: str = "step") -> DataFrame:
    """One row a step of the half-open [first, last); empty intervals give none."""
    return df.filter(F.col(first) < F.col(last)).withColumn(out, F.explode(F.sequence(F.col(first), F.col(last) - 1)))


def greedy_match(left: DataFrame, right: DataFrame, stratum: str, key: str, features: list[str]) -> DataFrame:
    """(stratum, left_key, right_key, distance): nearest match without replacement, left keys in order.

    Distances are Euclidean over features scaled by the deviation of all left rows. The order makes this
    sequential within a stratum, so a stratum's pairs are matched in one task: strata must be bounded (an arena, a day).
    Rows with null features don't take part. Ties go to the smaller right key.
    """
    ok = " AND ".join(f"`{f}` IS NOT NULL" for f in features)
    scale = left.filter(ok).agg(*[F.coalesce(F.nullif(F.stddev_pop(f), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{f}") for f in features])

    def prepared(df: DataFrame) -> DataFrame:
        d = df.filter(ok).crossJoin(F.broadcast(scale))
        # new names for old columns, so that a table can be matched with itself
        return d.select(F.col(stratum).alias(stratum), F.col(key).alias(key), *[(F.col(f) / F.col(f"_s_{f}")).alias(f) for f in features])

    kind = left.schema[key].dataType.simpleString()
    strat = left.schema[stratum].dataType.simpleString()

    def match(k, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["stratum", "left_key", "right_key", "distance"]
        a, b = a.sort_values(key), b.sort_values(key)
        x, y = a[features].to_numpy(float), b[features].to_numpy(float)
        free = np.ones(len(y), bool)
        rows = []
        for i in range(len(x)):
            if not free.any():
                break
            d = np.sqrt(((y - x[i]) ** 2).sum(1))
            d[~free] = np.inf
            j = int(d.argmin())
            free[j] = False
            rows.append((k[0], a[key].iloc[i], b[key].iloc[j], float(d[j])))
        return pd.DataFrame(rows, columns=names)

    return (
        prepared(left).groupBy(stratum).cogroup(prepared(right).groupBy(stratum))
        .applyInPandas(match, f"stratum {strat}, left_key {kind}, right_key {kind}, distance double")
    )


def co_occurrence(df: DataFrame, basket: str, item: str, least: int = 1, hold: int = 500_000) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, cosine) of ordered pairs item_a <> item_b on ``least`` or more common baskets.

    Repeats count once; rows with a null basket or item don't count. A task adds its baskets' pairs up before it hands
    anything on, so the shuffle grows with the kinds of pairs, not with the pairs of every basket. A basket's list is bounded
    by the number of items. Items on fewer than ``least`` baskets can't be in a pair and are dropped first.
    """
    p = df.select(F.col(basket).cast("string").alias("_b"), F.col(item).cast("string").alias("_i")).filter("_b IS NOT NULL AND _i IS NOT NULL").distinct()
    n = p.groupBy("_i").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    lists = p.join(n, "_i").groupBy("_b").agg(F.collect_list("_i").alias("items")).filter(F.size("items") > 1).select("items")

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def hand_on() -> pd.DataFrame:
            out = pd.DataFrame([(a, b, k) for (a, b), k in held.items()], columns=["a", "b", "k"])
            held.clear()
            return out

        for pdf in batches:
            for basket_items in pdf["items"]:
                b = sorted(basket_items)
                # a basket of any size: what is held is looked at after each first item
                for i, first in enumerate(b):
                    held.update(zip(repeat(first), b[i + 1 :]))
                    if len(held) >= hold:
                        yield hand_on()
        if held:
            yield hand_on()

    half = lists.mapInPandas(add_up, "a string, b string, k long").groupBy("a", "b").agg(F.sum("k").alias("n_ab")).filter(F.col("n_ab") >= least)
    both = half.select(F.inline(F.array(F.struct(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_ab"), F.struct(F.col("b").alias("item_a"), F.col("a").alias("item_b"), "n_ab"))))
    both = both.join(n.select(F.col("_i").alias("item_a"), F.col("_n").alias("n_a")), "item_a")
    both = both.join(n.select(F.col("_i").alias("item_b"), F.col("_n").alias("n_b")), "item_b")
    return both.withColumn("cosine", F.col("n_ab") / F.sqrt(F.col("n_a").cast("double") * F.col("n_b")))
