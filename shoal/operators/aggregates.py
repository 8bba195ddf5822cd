"""Aggregates with a fixed answer on ties and degenerate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.operators.scans import range_blocks, running


def mode_of(df: DataFrame, by: list[str], column: str, out: str = "mode") -> DataFrame:
    """Most frequent non-null value of each group; ties go to the smallest value. Counts combine before the shuffle."""
    n = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    # the smallest value among the most frequent ones: max of (n, value reversed) as min of (-n, value)
    return n.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias("_m")).select(*by, F.col("_m.v").alias(out))


def ordered_list(value: str, *order: str) -> Column:
    """A group's values as an array in the given order (ties by value). The group must be bounded."""
    s = F.array_sort(F.collect_list(F.struct(*order, value)))
    return F.transform(s, lambda x: x[value])


def quantile_bucket(df: DataFrame, column: str, cuts: list[float], labels: list[str], by: list[str] | None = None, out: str = "bucket") -> DataFrame:
    """Equal-frequency buckets with right-closed edges at exact quantiles; null stays null."""
    edges = [F.percentile(column, F.lit(q)).alias(f"_q{i}") for i, q in enumerate(cuts)]
    if by:
        d = df.join(df.groupBy(*by).agg(*edges), by)
    else:
        d = df.crossJoin(F.broadcast(df.agg(*edges)))
    c = F.lit(labels[-1])
    for i in reversed(range(len(cuts))):
        c = F.when(F.col(column) <= F.col(f"_q{i}"), labels[i]).otherwise(c)
    return d.withColumn(out, F.when(F.col(column).isNotNull(), c)).select(*df.columns, out)


def average_rank(column: str, by: list[str], descending: bool = False) -> Column:
    """Rank within ``by`` with ties averaged; null stays null and is not counted."""
    o = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    ties = Window.partitionBy(*by, column)
    return F.when(F.col(column).isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(o)) + (F.count("*").over(ties) - 1) / 2.0)


def ranked(df: DataFrame, column: str, by: list[str], out: str = "rank") -> DataFrame:
    """df with the average rank of a column within ``by`` and the share ``<out>_pct`` of ranked values.

    The distinct values of a numeric column are ranked, not the rows, block by block of its range: neither many ties nor one
    large group gathers in a task.
    """
    n = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    n = range_blocks(n, column).withColumn("_one", F.lit(1))
    r = running(n, by or ["_one"], [column], "_b", "_n", "sum", "_to")
    total = n.groupBy(*(by or ["_one"])).agg(F.sum("_n").alias("_all"))
    r = r.withColumn(out, F.col("_to") - F.col("_n") + (F.col("_n") + 1) / 2.0)
    on = [F.col(c).eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate(by or ["_one"])]
    r = r.join(total.withColumnsRenamed({c: f"_t{i}" for i, c in enumerate(by or ["_one"])}), on)
    r = r.select(*by, column, out, (F.col(out) / F.col("_all")).alias(f"{out}_pct"))
    keys = [*by, column]
    r = r.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(keys)})
    cond = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return df.join(r, cond, "left").select(*df.columns, out, f"{out}_pct")


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where neither is null, 0 where a side is constant. (corr() itself fails on constants.)"""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    c = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))


def sharpe(x: Column, periods: float = 365.0, bound: float = 10.0) -> Column:
    """Mean over population deviation, annualised, within +-bound; 0 where flat."""
    sd = F.stddev_pop(x)
    v = F.when(sd > 0, F.avg(x) / sd * (periods**0.5)).otherwise(0.0)
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), F.coalesce(v, F.lit(0.0))))
