"""Window expressions: frames with least periods, islands, states, drawdown. Each takes a window ordered without ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "pstd": F.stddev_pop,
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}


def rolling(column: str, rows: int, least: int, how: str):
    """Function of a window: an aggregate over the trailing ``rows`` rows, null until ``least`` of them are not null."""

    def over(w) -> Column:
        f = w.rowsBetween(-(rows - 1), 0)
        return F.when(F.count(column).over(f) >= least, _AGG[how](column).over(f))

    return over


def change(column: str, rows: int):
    return lambda w: F.col(column) - F.lag(column, rows).over(w)


def simple_return(column: str):
    """Row-over-row return, 0 on the first row."""
    return lambda w: F.coalesce(F.col(column) / F.lag(column).over(w) - 1, F.lit(0.0))


def log_return(column: str):
    return lambda w: F.coalesce(F.ln(F.col(column) / F.lag(column).over(w)), F.lit(0.0))


def set_reset(enter: Column, leave: Column):
    """Two-state machine: 1 from a row where ``enter`` holds until one where ``leave`` holds; rows where neither
    does keep the state. Right where both never hold on one row and neither depends on the state."""
    mark = F.when(F.coalesce(enter, F.lit(False)), 1).when(F.coalesce(leave, F.lit(False)), 0)
    return lambda w: F.coalesce(F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def islands(df: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """Runs of consecutive rows with flag = 1: (by, first, last, rows, open). ``open`` marks a run that reaches the entity's last row."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("_starts", ((F.col(flag) == 1) & (F.coalesce(F.lag(flag).over(w), F.lit(0)) != 1)).cast("int"))
    d = d.withColumn("_next", F.lead(order).over(w)).withColumn("_id", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        d.filter(F.col(flag) == 1)
        .groupBy(*by, "_id")
        .agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"), F.max(F.col("_next").isNull()).alias("open"))
        .drop("_id")
    )


def rising_edges(flag: str, w) -> Column:
    """1 where a run begins, a run that is open on the first row included."""
    return ((F.col(flag) == 1) & (F.coalesce(F.lag(flag).over(w), F.lit(0)) == 0)).cast("int")
