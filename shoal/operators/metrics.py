"""Ranking, classification and audit metrics as aggregations. A metric without any row to judge is null unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.operators.aggregates import pearson, ranked
from shoal.operators.scans import range_blocks, running


def ndcg(ranked_items: DataFrame, relevant: DataFrame, user: str, item: str, rank: str = "rank", k: int = 20) -> DataFrame:
    """(user, ndcg) of every user with relevant items, binary gain, 0 for users without a hit."""
    rel = relevant.select(user, item).distinct()
    hits = ranked_items.filter(F.col(rank) <= k).join(rel, [user, item]).groupBy(user).agg(F.sum(1 / F.log2(F.col(rank) + 1.0)).alias("dcg"))
    ideal = rel.groupBy(user).agg(F.count("*").alias("n"))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return ideal.join(hits, user, "left").select(user, (F.coalesce("dcg", F.lit(0.0)) / best).alias("ndcg"))


def score_steps(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """One row a distinct score from high to low: positives and rows at it (pos, n) and up to it (cum_pos, cum_n).

    Tied scores are one threshold. Rows with a null score or label are left out.
    """
    by = by or []
    s = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, (-F.col(score).cast("double")).alias("neg"))
    s = range_blocks(s.agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n")), "neg").withColumn("_one", F.lit(1))
    ent = by or ["_one"]
    s = running(s, ent, ["neg"], "_b", "pos", "sum", "cum_pos")
    return running(s, ent, ["neg"], "_b", "n", "sum", "cum_n").select(*by, (-F.col("neg")).alias("score"), "pos", "n", "cum_pos", "cum_n")


def average_precision(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Average precision (per group): sum over thresholds of recall gained times precision."""
    s = score_steps(df, score, label, by)
    return s.groupBy(*(by or [])).agg(F.try_divide(F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")), F.sum("pos")).alias("average_precision"))


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None, single_class: float | None = 0.5) -> DataFrame:
    """Area under the ROC curve with ties counted half; ``single_class`` where only one class is there (null: no guard)."""
    s = score_steps(df, score, label, by)
    below = F.sum(F.col("pos") * (-F.col("cum_n") + F.col("cum_pos") + 0.5 * (F.col("n") - F.col("pos"))))
    p, q = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    # negatives ranked below each positive = all negatives - those at or above + half of those tied
    value = F.try_divide(p * q + below, p * q)
    return s.groupBy(*(by or [])).agg(F.coalesce(value, F.lit(single_class).cast("double")).alias("auc"))


def spearman_by_group(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation of each group, 0 where a side is constant. Rows with a null side are left out."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = ranked(ranked(d, x, by, "_rx"), y, by, "_ry")
    return d.groupBy(*by).agg(pearson(F.col("_rx"), F.col("_ry")).alias("spearman"))


def precision_lift(df: DataFrame, label: str, chosen: str) -> DataFrame:
    """Precision among chosen rows over the base rate, as (precision - base) / (1 - base) within [0, 1]."""
    base, prec = F.avg(F.col(label).cast("double")), F.avg(F.when(F.col(chosen) == 1, F.col(label).cast("double")))
    lift = F.try_divide(F.coalesce(prec, F.lit(0.0)) - base, 1 - base)
    return df.agg(base.alias("base_rate"), prec.alias("precision"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(lift, F.lit(0.0)))).alias("lift"))


def rank_biased_overlap(pred: Column, truth: Column, depth: int = 10, p: float = 0.9) -> Column:
    """Truncated rank-biased overlap of two arrays; null entries of ``truth`` are positions not observed.

    Agreement at depth d is the share of the observed truth up to d that is among the first d predictions. Depths without
    observed truth are skipped and the weights renormalised; 0 without any.
    """

    def step(acc: Column, d: Column) -> Column:
        seen = F.array_distinct(F.filter(F.slice(truth, 1, d), lambda x: x.isNotNull()))
        w = F.pow(F.lit(p), d - 1.0)
        got = F.size(F.array_intersect(F.slice(pred, 1, d), seen))
        has = F.size(seen) > 0
        return F.struct(
            (acc["num"] + F.when(has, w * got / F.size(seen)).otherwise(0.0)).alias("num"), (acc["den"] + F.when(has, w).otherwise(0.0)).alias("den")
        )

    zero = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), zero, step)
    return F.coalesce(F.try_divide(total["num"], total["den"]), F.lit(0.0))


def rank_biased_overlap_full(a: Column, b: Column, depth: int = 10, p: float = 0.9) -> Column:
    """The incremental form for two complete rankings."""

    def step(acc: Column, d: Column) -> Column:
        return acc + F.pow(F.lit(p), d - 1.0) * F.size(F.array_intersect(F.slice(a, 1, d), F.slice(b, 1, d))) / d

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0.0), step) * F.lit((1 - p) / (1 - p**depth))


def bucket_mean(df: DataFrame, bucket: str, value: str) -> DataFrame:
    """Mean of the buckets' means; buckets without rows don't count."""
    return df.groupBy(bucket).agg(F.avg(value).alias("_m")).agg(F.avg("_m").alias("bucket_mean"))


def detection(df: DataFrame, truth: str, flag: str, clean: str = "none") -> DataFrame:
    """Macro recall over the classes other than ``clean``, specificity on it, and their mean."""
    per = df.groupBy(truth).agg(F.avg((F.col(flag) == 1).cast("double")).alias("_r"))
    rec = F.avg(F.when(F.col(truth) != clean, F.col("_r")))
    spec = F.max(F.when(F.col(truth) == clean, 1 - F.col("_r")))
    both = (F.coalesce(rec, F.lit(0.0)) + F.coalesce(spec, F.lit(0.0))) / F.greatest(rec.isNotNull().cast("int") + spec.isNotNull().cast("int"), F.lit(1))
    return per.agg(rec.alias("recall"), spec.alias("specificity"), both.alias("balanced"))


def consistency(df: DataFrame, flag: str, mode: str, unchanged: str, clean: str = "none") -> DataFrame:
    """Counts of the four contradictions between a flag, a named mode and whether the answer was left as it was."""
    f, m, u = F.col(flag), F.col(mode), F.col(unchanged)
    v = [(f == 0) & ~u, (f == 1) & u, (f == 0) & (m != clean), (f == 1) & (m == clean)]
    bad = v[0] | v[1] | v[2] | v[3]
    return df.agg(
        *[F.sum(c.cast("long")).alias(f"v{i + 1}") for i, c in enumerate(v)],
        (1 - F.avg(bad.cast("double"))).alias("consistency"),
        (0.7 + 0.3 * (1 - F.avg(bad.cast("double")))).alias("multiplier"),
    )


def top_k_accuracy(ranked_labels: DataFrame, truth: DataFrame, key: str, label: str, rank: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of keys with a non-null truth whose label is ranked among the first k."""
    t = truth.filter(F.col(label).isNotNull()).select(key, label)
    j = t.join(ranked_labels.select(key, label, rank), [key, label], "left")
    return j.agg(F.count("*").alias("n"), *[F.avg(F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0))).alias(f"top{k}") for k in ks])


def ungrounded_rate(items: DataFrame, catalog: DataFrame, item: str) -> DataFrame:
    """Share of rows whose item isn't in the catalog."""
    known = catalog.select(item).distinct().withColumn("_known", F.lit(1))
    return items.join(known, item, "left").agg(F.avg(F.col("_known").isNull().cast("double")).alias("ungrounded"))


def weighted(parts: dict[str, float], low: float = 0.0, high: float = 1.0) -> Column:
    """Weighted sum of columns within bounds."""
    total = F.lit(0.0)
    for c, w in parts.items():
        total = total + F.col(c) * w
    return F.greatest(F.lit(low), F.least(F.lit(high), total))


def candidate_recall(candidates: DataFrame, truth: DataFrame, user: str, item: str) -> DataFrame:
    """(user, n_truth, n_hit, n_candidates, recall) of every user that has true items; repeats count once, nulls don't count.

    recall is the share of a user's true items among their candidates; a user without candidates has recall 0.
    """
    c, t = (x.select(user, item).filter(F.col(user).isNotNull() & F.col(item).isNotNull()).distinct() for x in (candidates, truth))
    # one pass over both sides, grouped once
    both = c.withColumn("_c", F.lit(1)).withColumn("_t", F.lit(0)).unionByName(t.withColumn("_c", F.lit(0)).withColumn("_t", F.lit(1)))
    pair = both.groupBy(user, item).agg(F.max("_c").alias("_c"), F.max("_t").alias("_t"))
    by = pair.groupBy(user).agg(F.sum("_t").alias("n_truth"), F.sum(F.col("_c") * F.col("_t")).alias("n_hit"), F.sum("_c").alias("n_candidates"))
    return by.filter("n_truth > 0").withColumn("recall", F.col("n_hit") / F.col("n_truth"))


def catalog_coverage(candidates: DataFrame, catalog: DataFrame, item: str) -> DataFrame:
    """One row (n_items, n_covered, coverage): the share of the catalog's items that are anyone's candidate; null for an empty catalog."""
    have = candidates.select(item).distinct().withColumn("_h", F.lit(1))
    d = catalog.select(item).filter(F.col(item).isNotNull()).distinct().join(have, item, "left")
    return d.agg(F.count("*").alias("n_items"), F.count("_h").alias("n_covered")).withColumn("coverage", F.try_divide("n_covered", "n_items"))


def cumulative_share(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each value and its share of all rows."""
    # the total is one row
    return df.groupBy(column).agg(F.count("*").alias("n")).crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")
