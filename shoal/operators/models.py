"""Learned models on Spark ML, split by group or time, with weights and threshold search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.operators.features import hash_fold


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight n / (2 * n of the class), so that both classes weigh the same."""
    n = df.agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))
    w = F.when(F.col(label) == 1, F.try_divide(F.col("_n"), 2.0 * F.col("_p"))).otherwise(F.try_divide(F.col("_n"), 2.0 * (F.col("_n") - F.col("_p"))))
    return df.crossJoin(F.broadcast(n)).withColumn(out, w).drop("_n", "_p")


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    filled = df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=features, outputCol="_x").transform(filled)


def _no_rows(train: DataFrame, test: DataFrame) -> DataFrame | None:
    """test with a null score, if there is nothing to learn from."""
    return None if train.limit(1).count() else test.withColumn("score", F.lit(None).cast("double"))


def boosted_scores(train: DataFrame, test: DataFrame, label: str, features: list[str], weight: str | None = None, seed: int = 7, rounds: int = 10) -> DataFrame:
    """test with ``score``: probability of label 1 from gradient-boosted trees (missing features count as 0; null without training rows)."""
    if (none := _no_rows(train, test)) is not None:
        return none
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    gbt = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=4, seed=seed, **({"weightCol": weight} if weight else {}))
    model = gbt.fit(_assembled(train.withColumn(label, F.col(label).cast("double")), features))
    return model.transform(_assembled(test, features)).withColumn("score", vector_to_array("probability")[1]).select(*test.columns, "score")


def boosted_values(train: DataFrame, test: DataFrame, label: str, features: list[str], seed: int = 7, rounds: int = 10) -> DataFrame:
    """test with ``score`` from gradient-boosted regression trees; also a pointwise ranker when the label is a relevance. Null without training rows."""
    if (none := _no_rows(train, test)) is not None:
        return none
    from pyspark.ml.regression import GBTRegressor

    gbt = GBTRegressor(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=4, seed=seed, predictionCol="score")
    model = gbt.fit(_assembled(train.withColumn(label, F.col(label).cast("double")), features))
    return model.transform(_assembled(test, features)).select(*test.columns, "score")


def out_of_fold(df: DataFrame, group: str, folds: int, fit_score) -> DataFrame:
    """df scored fold by fold, no group on both sides; fit_score(train, test) -> test with score."""
    d = df.withColumn("_fold", hash_fold(F.col(group), folds))
    parts = [fit_score(d.filter(F.col("_fold") != k), d.filter(F.col("_fold") == k)) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_fold")


def temporal_split(df: DataFrame, at: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff, and from it on."""
    return df.filter(F.col(at) < cutoff), df.filter(F.col(at) >= cutoff)


def threshold_search(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """(threshold, precision, recall, f1) for each stated threshold, in one aggregation."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))
    d = df.select(score, label, t.alias("threshold")).groupBy("threshold")
    hit, pos = F.col(score) >= F.col("threshold"), F.col(label) == 1
    c = d.agg(F.count(F.when(hit & pos, 1)).alias("tp"), F.count(F.when(hit, 1)).alias("h"), F.count(F.when(pos, 1)).alias("p"))
    return c.select("threshold", F.coalesce(F.try_divide("tp", "h"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("tp", "p"), F.lit(0.0)).alias("recall"),
                    F.coalesce(F.try_divide(2 * F.col("tp"), F.col("h") + F.col("p")), F.lit(0.0)).alias("f1"))
