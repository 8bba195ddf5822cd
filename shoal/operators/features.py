"""Feature blocks: sensor trends, recent counters, dueness, shares, kernels, splits, quantile maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.operators.clean import without_sentinel
from shoal.operators.scans import fill_forward, trailing
from shoal.operators.windows import change, rolling


def sensor_block(df: DataFrame, entity: str, at: str, tie: str, sensors: list[str], block: str) -> DataFrame:
    """Per sensor: trailing means of 6 and 24 rows, deviation of 24, change over 48, ratio to the median of 168, trend 6 to 48.

    -999.0 is missing; gaps are filled from before, then from after. ``block`` is a SQL expression non-decreasing in time.
    """
    d = df.withColumns({c: without_sentinel(F.col(c)) for c in sensors}).withColumn("_b", F.expr(block))
    d = fill_forward(d, [entity], [at, tie], "_b", sensors, back=True)
    cols = {}
    for c in sensors:
        m6, m48 = rolling(c, 6, 2, "mean"), rolling(c, 48, 12, "mean")
        cols |= {
            f"{c}_m6": m6,
            f"{c}_m24": rolling(c, 24, 6, "mean"),
            f"{c}_sd24": rolling(c, 24, 6, "std"),
            f"{c}_diff48": change(c, 48),
            f"{c}_rel168": lambda w, c=c: F.col(c) / (F.abs(rolling(c, 168, 24, "median")(w)) + 1e-3),
            f"{c}_trend": lambda w, a=m6, b=m48: a(w) - b(w),
        }
    return trailing(d, [entity], [at, tie], "_b", 168, cols).drop("_b")


def recent_counts(df: DataFrame, by: list[str], kind: str, kinds: list[str], when: Column) -> DataFrame:
    """Rows of each kind for which ``when`` holds, one pass for all kinds."""
    return df.groupBy(*by).agg(*[F.count(F.when((F.col(kind) == k) & when, 1)).alias(f"n_{k}") for k in kinds])


def dueness(df: DataFrame, by: list[str], week: str, now: int, fallback: float = 2.0) -> DataFrame:
    """(by, weeks, first, last, gap, due): weeks since the last over the typical gap between active weeks, within 0 to 4.

    Where a pair has one active week its gap is the median gap of the last ``by`` column's pairs, then ``fallback``; at least 0.5.
    """
    g = df.groupBy(*by).agg(F.count_distinct(week).alias("weeks"), F.min(week).alias("first"), F.max(week).alias("last"))
    g = g.withColumn("gap", F.when(F.col("weeks") > 1, (F.col("last") - F.col("first")) / (F.col("weeks") - 1)))
    med = g.filter("gap > 0").groupBy(by[-1]).agg(F.median("gap").alias("_m"))
    g = g.join(med, by[-1], "left")
    gap = F.greatest(F.coalesce(F.when(F.col("gap") > 0, F.col("gap")), F.col("_m"), F.lit(fallback)), F.lit(0.5))
    return g.withColumn("gap", gap).withColumn("due", F.least(F.greatest((F.lit(now) + 1 - F.col("last")) / F.col("gap"), F.lit(0.0)), F.lit(4.0))).select(*by, "weeks", "first", "last", "gap", "due")


def share_of_total(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """(by, n, share): rows of each group and their share of all rows of the ``within`` columns."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def gaussian_kernel(value: Column, centre: Column, width: float) -> Column:
    """exp(-z*z/2) of the log ratio over ``width``; 0 where a side is not positive."""
    z = (F.ln(F.when(value > 0, value)) - F.ln(F.when(centre > 0, centre))) / width
    return F.coalesce(F.exp(-0.5 * z * z), F.lit(0.0))


def half_life(age: Column, half: float) -> Column:
    return F.pow(F.lit(0.5), age / half)


def hash_fold(key: Column, folds: int, seed: str = "fold") -> Column:
    """Fold from 0 by a digest of the key: the same on any engine, and all rows of a key together."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.lit(":"), key.cast("string")), 256), 1, 8), 16, 10).cast("long") % folds


def quantile_map(df: DataFrame, pct: str, knots: DataFrame, out: str = "mapped") -> DataFrame:
    """Piecewise-linear map of a percentile through knots (x, y) ascending in x; flat outside. The knots are a small stated table."""
    k = knots.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("_k"))
    d = df.crossJoin(F.broadcast(k))
    v = F.col(pct)
    below, above = F.filter("_k", lambda t: t["x"] <= v), F.filter("_k", lambda t: t["x"] > v)
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    y = F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (v - a["x"]) / (b["x"] - a["x"]))
    return d.withColumn(out, F.when(v.isNotNull(), y)).drop("_k")


def complete_windows(df: DataFrame, origins: DataFrame, entity: str, hour: str, rows: int) -> DataFrame:
    """The ``rows`` hours up to each entity's origin (entity, snapshot, origin), only where all of them are there."""
    o = origins.select(entity, "snapshot", "origin")
    j = df.join(o, entity).filter((F.col(hour) > F.col("origin") - rows) & (F.col(hour) <= F.col("origin")))
    full = j.groupBy("snapshot").agg(F.count_distinct(hour).alias("_n")).filter(F.col("_n") == rows).select("snapshot")
    return j.join(full, "snapshot", "left_semi")
