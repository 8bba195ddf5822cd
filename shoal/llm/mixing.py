"""Mixing sources to target shares of the total size, with a cap on how often a record repeats.

Shares are allotted by water-filling: a source that would need more than its cap is clamped there
and its excess goes to the others in proportion to their targets, until all fit. A source is
then drawn in whole passes plus a part of one more; the part is the records first in a seeded
hash order up to the size still missing, found from sums over hash buckets.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.session import materialized

#: Where the vocabulary files of public tokenizers are; a parameter of every function that needs one.
TOKENIZERS = os.environ.get("SHOAL_TOKENIZERS", "/opt/tokenizers")
# fixed value: the pattern that splits text before the merges of byte-level rank files
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HASH_BUCKETS = 4096


def token_counts(docs: DataFrame, text: str = "text", out: str = "tokens", ranks: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """docs' other columns and the number of tokens of each whole text; a null or empty text has none."""
    rest = [c for c in docs.columns if c != text and c != out]
    schema = docs.select(*rest).schema.add(out, "long")
    path = str(Path(folder) / ranks)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(path, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf[text]]
            yield pdf[rest].assign(**{out: n})

    return docs.select(*rest, text).mapInPandas(count, schema)


def water_fill(size: dict[str, int], target: dict[str, float], cap: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Size to draw from each source. Sources without records, target or cap get nothing; ``total`` defaults to
    the size of all sources that have a target. If the caps can't hold the total, every source is drawn to its cap."""
    usable = [s for s in target if size.get(s, 0) > 0 and (target[s] or 0) > 0 and (cap.get(s) or 0) > 0]
    total = float(sum(size[s] for s in usable)) if total is None else total
    out = dict.fromkeys(target, 0.0)
    open_, left = set(usable), total
    while open_:
        weight = sum(target[s] for s in open_)
        clamped = {s for s in open_ if left * target[s] / weight > cap[s] * size[s]}
        if not clamped:
            for s in open_:
                out[s] = left * target[s] / weight
            break
        for s in clamped:
            out[s] = float(cap[s] * size[s])
            left -= out[s]
        open_ -= clamped
    return out


def plan_mixture(sized: DataFrame, targets: DataFrame, source: str = "source", tokens: str = "tokens", total: float | None = None) -> DataFrame:
    """One row a target source: size, target_share, max_repeats, allotted size, whole passes, size of the part.

    The targets are a stated table of a few sources; one row each reaches the driver.
    """
    spark = sized.sparkSession
    sums = sized.groupBy(source).agg(F.sum(tokens).alias("size"), F.count("*").alias("records"))
    t = targets.groupBy(source).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter(F.col(source).isNotNull())
    rows = t.join(sums, source, "left").collect()
    size = {r[source]: int(r["size"] or 0) for r in rows}
    allotted = water_fill(size, {r[source]: r["target_share"] for r in rows}, {r[source]: r["max_repeats"] for r in rows}, total)
    out = []
    for r in rows:
        s, a = r[source], allotted[r[source]]
        whole = min(int(a // size[s]) if size[s] else 0, r["max_repeats"] or 0)
        part = a - whole * size[s] if whole < (r["max_repeats"] or 0) else 0.0
        out.append((s, size[s], int(r["records"] or 0), r["target_share"], r["max_repeats"], a, whole, part))
    kind = sized.schema[source].dataType.simpleString()
    return spark.createDataFrame(
        out, f"{source} {kind}, size long, records long, target_share double, max_repeats int, allotted double, whole int, part double"
    )


def draw_mixture(sized: DataFrame, plan: DataFrame, key: str, source: str = "source", tokens: str = "tokens", seed: int = 7) -> DataFrame:
    """(key, source, tokens, copies) of every record drawn, copies from 1 to its source's max_repeats.

    Records of no size are never drawn. The same seed and records give the same draw. A source's drawn size is
    its allotted size to within one record.
    """
    # a row a source: the plan is as small as the stated targets
    r = sized.filter(F.col(tokens) > 0).join(F.broadcast(plan.select(source, "whole", "part").filter("whole > 0 OR part > 0")), source)
    h = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    r = r.select(key, source, tokens, "whole", "part", h.alias("h"), F.pmod(h, F.lit(HASH_BUCKETS)).cast("int").alias("hb"))
    sums = r.groupBy(source, "hb").agg(F.sum(tokens).alias("s"), F.max("part").alias("part"))
    # HASH_BUCKETS rows a source at most
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy(source).orderBy("hb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = before.filter((F.col("before") < F.col("part")) & (F.col("before") + F.col("s") > F.col("part"))).select(source, F.col("hb").alias("cut"), "before")
    full = before.filter(F.col("before") + F.col("s") <= F.col("part")).groupBy(source).agg(F.max("hb").alias("upto"))
    # as many rows as targets
    edge = plan.select(source).join(cut, source, "left").join(full, source, "left")
    r = r.join(F.broadcast(edge), source, "left")
    inside = F.coalesce(F.col("hb") <= F.col("upto"), F.lit(False))
    easy = r.filter(~F.coalesce(F.col("hb") == F.col("cut"), F.lit(False))).withColumn("extra", inside.cast("int"))
    # only the records of one bucket in HASH_BUCKETS are put in order
    w = Window.partitionBy(source).orderBy("h", key)
    hard = r.filter(F.col("hb") == F.col("cut")).withColumn("run", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before"))
    hard = hard.withColumn("extra", (F.col("run") - F.col(tokens) / 2 <= F.col("part")).cast("int")).drop("run")
    drawn = easy.unionByName(hard).withColumn("copies", F.col("whole") + F.col("extra"))
    return drawn.filter("copies > 0").select(key, source, tokens, "copies")


def actual_shares(drawn: DataFrame, plan: DataFrame, source: str = "source", tokens: str = "tokens") -> DataFrame:
    """Per target source: target, allotted and actual share, size drawn, records drawn, most copies, and whether the cap held it."""
    got = drawn.groupBy(source).agg(F.sum(F.col(tokens) * F.col("copies")).alias("drawn"), F.count("*").alias("records_drawn"), F.max("copies").alias("most_copies"))
    p = plan.join(got, source, "left").fillna(0, ["drawn", "records_drawn", "most_copies"])
    w = Window.partitionBy(F.lit(0))
    return p.select(
        source,
        "target_share",
        F.coalesce(F.try_divide(F.col("allotted"), F.sum("allotted").over(w)), F.lit(0.0)).alias("allotted_share"),
        F.coalesce(F.try_divide(F.col("drawn"), F.sum("drawn").over(w)), F.lit(0.0)).alias("actual_share"),
        "drawn",
        "records_drawn",
        "most_copies",
        ((F.col("size") > 0) & (F.col("allotted") >= F.col("size") * F.col("max_repeats"))).alias("capped"),
    )


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, **tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """(records drawn, actual shares) for documents measured in tokens; sources without a target aren't drawn."""
    sized = materialized(token_counts(docs.select(key, source, text), text, **tokenizer), "sized")
    plan = plan_mixture(sized, targets, source)
    drawn = draw_mixture(sized, plan, key, source, seed=seed)
    return drawn, actual_shares(drawn, plan, source)
