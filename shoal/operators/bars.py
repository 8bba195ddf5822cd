"""Bars of a price-like series: resampling, position rules, trades and their results.

A series is (arena, step, ...), steps counting from 0 without holes; all rules are windows over an arena's steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.operators.aggregates import pearson, sharpe
from shoal.operators.windows import islands, rolling, set_reset, simple_return

_FIRST = Window.unboundedPreceding


def arena_window(arena: str = "arena"):
    return Window.partitionBy(arena).orderBy("step")


def resample(df: DataFrame, arena: str, at: str, key: str, price: str, volume: str | None = None, unit: str = "day") -> DataFrame:
    """(arena, bar, step, open, high, low, close, volume): bars of a time unit; open and close by time, ties by key.

    One pass of mergeable aggregates. Rows with a null arena, time or price are left out.
    """
    d = df.filter(F.col(arena).isNotNull() & F.col(at).isNotNull() & F.col(price).isNotNull())
    order = F.struct(at, key)
    b = d.groupBy(F.col(arena).alias("arena"), F.date_trunc(unit, at).alias("bar")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        (F.sum(volume) if volume else F.count("*")).cast("double").alias("volume"),
    )
    return b.withColumn("step", F.row_number().over(Window.partitionBy("arena").orderBy("bar")) - 1)


def contiguous_arenas(bars: DataFrame, gap_days: int = 1, least: int = 2) -> DataFrame:
    """Arenas with at least ``least`` bars, each ``gap_days`` after the one before, and only sound prices."""
    w = Window.partitionBy("arena").orderBy("bar")
    d = bars.withColumn("_g", F.datediff("bar", F.lag("bar").over(w)))
    sound = (F.col("low") > 0) & (F.col("volume") > 0) & (F.col("high") >= F.col("low"))
    return (
        d.groupBy("arena")
        .agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("_g") == gap_days, F.lit(True))).alias("_c"), F.bool_and(sound).alias("_s"))
        .filter((F.col("n") >= least) & F.col("_c") & F.col("_s"))
        .select("arena", "n")
    )


def normalised(bars: DataFrame, in_sample: int) -> DataFrame:
    """Prices over the first close, volume over its in-sample median."""
    w = arena_window()
    med = bars.groupBy("arena").agg(F.median(F.when(F.col("step") < in_sample, F.col("volume"))).alias("_m"))
    first = F.first("close").over(w.rowsBetween(_FIRST, 0))
    d = bars.join(med, "arena").withColumn("_f", first)
    return d.withColumns({**{c: F.col(c) / F.col("_f") for c in ("open", "high", "low", "close")}, "volume": F.try_divide("volume", "_m")}).drop("_f", "_m")


def with_regime(bars: DataFrame, window: int, quantile: float, in_sample: int) -> DataFrame:
    """bars with ret, logret, vol (trailing population deviation of logret) and high_vol (vol at or above its in-sample quantile)."""
    w = arena_window()
    d = bars.withColumn("ret", simple_return("close")(w)).withColumn("logret", F.coalesce(F.ln(F.col("close") / F.lag("close").over(w)), F.lit(0.0)))
    d = d.withColumn("vol", F.when(F.col("step") >= window, rolling("logret", window, window, "pstd")(w)))
    thr = d.groupBy("arena").agg(F.percentile(F.when(F.col("step") < in_sample, F.col("vol")), F.lit(quantile)).alias("_thr"))
    return d.join(thr, "arena").withColumn("high_vol", F.coalesce((F.col("vol") >= F.col("_thr")).cast("int"), F.lit(0))).drop("_thr")


def trend_position(fast: int, slow: int) -> Column:
    """1 where the fast mean of the close is above the slow one, once that is full."""
    w = arena_window()
    return F.coalesce((rolling("close", fast, fast, "mean")(w) > rolling("close", slow, slow, "mean")(w)).cast("int"), F.lit(0))


def breakout_position(df: DataFrame, enter: int, leave: int, out: str = "pos") -> DataFrame:
    """In when the close breaks the highest high of the ``enter`` bars before, out when it falls below the lowest low of ``leave``."""
    w = arena_window()
    hh = F.max("high").over(w.rowsBetween(-enter, -1))
    ll = F.min("low").over(w.rowsBetween(-leave, -1))
    d = df.withColumn("_in", (F.col("step") >= enter) & (F.col("close") > hh)).withColumn("_out", (F.col("step") >= leave) & (F.col("close") < ll))
    return d.withColumn(out, set_reset(F.col("_in"), F.col("_out"))(w)).drop("_in", "_out")


def reversion_position(df: DataFrame, window: int, z_in: float, z_out: float, out: str = "pos") -> DataFrame:
    """In below -z_in deviations of the trailing mean, out above -z_out; a flat or unfilled window keeps the state."""
    w = arena_window()
    sd = F.nullif(rolling("close", window, window, "pstd")(w), F.lit(0.0))
    d = df.withColumn("_z", F.try_divide(F.col("close") - rolling("close", window, window, "mean")(w), sd))
    return d.withColumn(out, set_reset(F.col("_z") < -z_in, F.col("_z") > -z_out)(w)).drop("_z")


def calm_momentum_position(df: DataFrame, window: int, quantile: float, momentum: int, in_sample: int, out: str = "pos") -> DataFrame:
    """1 where trailing volatility is below its in-sample quantile and the close is above that ``momentum`` bars ago."""
    w = arena_window()
    d = df.withColumn("_lr", F.coalesce(F.ln(F.col("close") / F.lag("close").over(w)), F.lit(0.0))).withColumn("_v", rolling("_lr", window, window, "pstd")(w))
    thr = d.groupBy("arena").agg(F.percentile(F.when(F.col("step") < in_sample, F.col("_v")), F.lit(quantile)).alias("_thr"))
    d = d.join(thr, "arena")
    up = F.col("close") > F.lag("close", momentum).over(w)
    return d.withColumn(out, F.coalesce(((F.col("_v") < F.col("_thr")) & up).cast("int"), F.lit(0))).drop("_lr", "_v", "_thr")


def trades(df: DataFrame, position: str = "pos") -> DataFrame:
    """(arena, entry_step, exit_step, open_at_cutoff, trade_return): runs of the position; one still open closes on the last step.

    exit_step is the first step out again. A run that begins on the last step comes out with entry = exit.
    """
    r = islands(df, ["arena"], "step", position)
    t = r.select("arena", F.col("first").alias("entry_step"), (F.col("last") + F.when(F.col("open"), 0).otherwise(1)).alias("exit_step"), F.col("open").cast("int").alias("open_at_cutoff"))
    c = df.select("arena", "step", "close")
    t = t.join(c.select("arena", F.col("step").alias("entry_step"), F.col("close").alias("_a")), ["arena", "entry_step"])
    t = t.join(c.select("arena", F.col("step").alias("exit_step"), F.col("close").alias("_b")), ["arena", "exit_step"])
    return t.select("arena", "entry_step", "exit_step", "open_at_cutoff", (F.col("_b") / F.col("_a") - 1).alias("trade_return"))


def profit(df: DataFrame, position: str = "pos") -> DataFrame:
    """df with pnl: yesterday's position times today's return, 0 on the first step."""
    w = arena_window()
    return df.withColumn("pnl", F.coalesce(F.lag(position).over(w) * simple_return("close")(w), F.lit(0.0)))


def quarter_sharpe(df: DataFrame) -> DataFrame:
    """(arena, quarter, sharpe): annualised over four near-equal stretches of an arena's steps after the first."""
    d = df.filter("step > 0").withColumn("quarter", F.ntile(4).over(arena_window()))
    return d.groupBy("arena", "quarter").agg(sharpe(F.col("pnl"), bound=1e9).alias("sharpe"))


def drawdown(df: DataFrame) -> DataFrame:
    """(arena, total, drawdown, autocorrelation) of the pnl."""
    w = arena_window()
    d = df.withColumn("_e", F.sum("pnl").over(w.rowsBetween(_FIRST, 0))).withColumn("_l", F.lag("pnl").over(w))
    d = d.withColumn("_d", F.max("_e").over(w.rowsBetween(_FIRST, 0)) - F.col("_e"))
    return d.groupBy("arena").agg(F.sum("pnl").alias("total"), F.max("_d").alias("drawdown"), pearson(F.col("pnl"), F.col("_l")).alias("autocorrelation"))


def behaviour(df: DataFrame, trade_log: DataFrame) -> DataFrame:
    """One row an arena: exposure, entries, trades, durations, win rates by volatility state at entry, alignment, Sharpe.

    df: arena, step, pos, ret, vol, high_vol, pnl.
    """
    w = arena_window()
    d = df.withColumn("_in", ((F.col("pos") == 1) & (F.coalesce(F.lag("pos").over(w), F.lit(0)) == 0)).cast("int")).withColumn("_nxt", F.lead("ret").over(w))
    steps = d.groupBy("arena").agg(
        F.avg("pos").alias("exposure"), F.sum("_in").alias("entries"), sharpe(F.when(F.col("step") > 0, F.col("pnl")), bound=1e9).alias("sharpe"),
        pearson(F.col("pos"), F.col("_nxt")).alias("alignment"),
    )
    t = trade_log.join(df.select("arena", F.col("step").alias("entry_step"), "high_vol"), ["arena", "entry_step"], "left")
    win = (F.col("trade_return") > 0).cast("double")
    hi = F.coalesce(F.col("high_vol"), F.lit(0)) == 1
    per = t.groupBy("arena").agg(
        F.count("*").alias("n_trades"), F.avg(F.greatest(F.col("exit_step") - F.col("entry_step"), F.lit(1))).alias("mean_duration"), F.avg(win).alias("win_rate"),
        F.coalesce(F.avg(F.when(hi, win)), F.lit(0.5)).alias("win_high"), F.coalesce(F.avg(F.when(~hi, win)), F.lit(0.5)).alias("win_low"), F.max("open_at_cutoff").alias("open_cut"),
    )
    return steps.join(per, "arena", "left").fillna(0, ["n_trades"])
