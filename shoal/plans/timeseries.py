"""Windows, fills, islands, sensor features, market rules and snapshots on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.operators import bars as B
from shoal.operators.features import complete_windows, dueness, gaussian_kernel, half_life, hash_fold, quantile_map, recent_counts, sensor_block, share_of_total
from shoal.operators.scans import fill_forward, running, trailing
from shoal.operators.windows import islands, rolling
from shoal.plans.registry import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

MONTH = "floor(unix_seconds(timestamp) / 2592000)"
_R = """r AS (SELECT reading_id, min(pump_id) AS pump_id, min("timestamp") AS ts, min(nullif(rpm, -999.0)) AS rpm, min(nullif(vibration_mm_s, -999.0)) AS v FROM sensor_readings GROUP BY reading_id)"""


def _readings(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "sensor_readings").groupBy("reading_id").agg(
        F.min("pump_id").alias("pump_id"), F.min("timestamp").alias("timestamp"), F.min(F.nullif(F.col("rpm"), F.lit(-999.0))).alias("rpm"), F.min(F.nullif(F.col("vibration_mm_s"), F.lit(-999.0))).alias("v")
    )
    return r.withColumn("b", F.expr(MONTH))


@query(
    "filled_readings",
    f"""WITH {_R} SELECT reading_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY pump_id ORDER BY ts, reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(v IGNORE NULLS) OVER (PARTITION BY pump_id ORDER BY ts, reading_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM r""",
)
def filled_readings(spark: SparkSession, d: str) -> DataFrame:
    return fill_forward(_readings(spark, d), ["pump_id"], ["timestamp", "reading_id"], "b", ["v"], back=True).select("reading_id", "v")


@query(
    "rolling_statistics",
    f"""WITH {_R}, w AS (SELECT reading_id, count(v) OVER f6 AS n6, avg(v) OVER f6 AS m6, count(v) OVER f24 AS n24, stddev_samp(v) OVER f24 AS s24, count(v) OVER f168 AS n168, quantile_cont(v, 0.5) OVER f168 AS md, max(v) OVER f24 AS hi, min(v) OVER f24 AS lo, v
    FROM r WINDOW f6 AS (PARTITION BY pump_id ORDER BY ts, reading_id ROWS 5 PRECEDING), f24 AS (PARTITION BY pump_id ORDER BY ts, reading_id ROWS 23 PRECEDING), f168 AS (PARTITION BY pump_id ORDER BY ts, reading_id ROWS 167 PRECEDING))
    SELECT reading_id, round(CASE WHEN n6 >= 2 THEN m6 END, 5) AS m6, round(CASE WHEN n24 >= 6 THEN s24 END, 5) AS sd24, round(CASE WHEN n168 >= 24 THEN md END, 5) AS med168, CASE WHEN n24 >= 1 THEN hi END AS hi, CASE WHEN n24 >= 1 THEN lo END AS lo FROM w""",
)
def rolling_statistics(spark: SparkSession, d: str) -> DataFrame:
    cols = {"m6": rolling("v", 6, 2, "mean"), "sd24": rolling("v", 24, 6, "std"), "med168": rolling("v", 168, 24, "median"), "hi": rolling("v", 24, 1, "max"), "lo": rolling("v", 24, 1, "min")}
    t = trailing(_readings(spark, d), ["pump_id"], ["timestamp", "reading_id"], "b", 168, cols)
    return t.select("reading_id", *[F.round(c, 5).alias(c) for c in ("m6", "sd24", "med168")], "hi", "lo")


@query(
    "sensor_features",
    f"""WITH {_R}, q AS (SELECT reading_id, pump_id, ts, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY pump_id ORDER BY ts, reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(v IGNORE NULLS) OVER (PARTITION BY pump_id ORDER BY ts, reading_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM r),
    w AS (SELECT reading_id, v, lag(v, 48) OVER o AS l48, count(v) OVER f6 AS n6, avg(v) OVER f6 AS m6, count(v) OVER f48 AS n48, avg(v) OVER f48 AS m48, count(v) OVER f168 AS n168, quantile_cont(v, 0.5) OVER f168 AS md FROM q
    WINDOW o AS (PARTITION BY pump_id ORDER BY ts, reading_id), f6 AS (PARTITION BY pump_id ORDER BY ts, reading_id ROWS 5 PRECEDING), f48 AS (PARTITION BY pump_id ORDER BY ts, reading_id ROWS 47 PRECEDING), f168 AS (PARTITION BY pump_id ORDER BY ts, reading_id ROWS 167 PRECEDING))
    SELECT reading_id, round(v - l48, 5) AS diff48, round(v / (abs(CASE WHEN n168 >= 24 THEN md END) + 1e-3), 5) AS rel168, round(CASE WHEN n6 >= 2 THEN m6 END - CASE WHEN n48 >= 12 THEN m48 END, 8) AS trend FROM w""",
)
def sensor_features(spark: SparkSession, d: str) -> DataFrame:
    f = sensor_block(_readings(spark, d).drop("b"), "pump_id", "timestamp", "reading_id", ["v"], MONTH)
    return f.select("reading_id", F.round("v_diff48", 5).alias("diff48"), F.round("v_rel168", 5).alias("rel168"), F.round("v_trend", 8).alias("trend"))


@query(
    "running_totals",
    f"""WITH {_R} SELECT reading_id, round(sum(v) OVER w, 4) AS total, max(v) OVER w AS peak, count(v) OVER w AS known FROM r
    WINDOW w AS (PARTITION BY pump_id ORDER BY ts, reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def running_totals(spark: SparkSession, d: str) -> DataFrame:
    x, o = _readings(spark, d), ["timestamp", "reading_id"]
    x = running(x, ["pump_id"], o, "b", "v", "sum", "total")
    x = running(x, ["pump_id"], o, "b", "v", "max", "peak")
    x = running(x, ["pump_id"], o, "b", "v", "count", "known")
    return x.select("reading_id", F.round("total", 4).alias("total"), "peak", "known")


@query(
    "stopped_runs",
    f"""WITH {_R}, a AS (SELECT pump_id, ts, CASE WHEN rpm = 0 THEN 1 ELSE 0 END AS f, row_number() OVER (PARTITION BY pump_id ORDER BY ts) AS n, max(ts) OVER (PARTITION BY pump_id) AS mx FROM (SELECT pump_id, ts, min(rpm) AS rpm FROM r GROUP BY 1, 2)),
    g AS (SELECT *, n - row_number() OVER (PARTITION BY pump_id, f ORDER BY ts) AS grp FROM a)
    SELECT pump_id, CAST(epoch(min(ts)) AS BIGINT) AS first_s, CAST(epoch(max(ts)) AS BIGINT) AS last_s, count(*) AS rows, max(ts) = max(mx) AS open FROM g WHERE f = 1 GROUP BY pump_id, grp""",
)
def stopped_runs(spark: SparkSession, d: str) -> DataFrame:
    r = _readings(spark, d).groupBy("pump_id", "timestamp").agg(F.min("rpm").alias("rpm")).withColumn("f", F.when(F.col("rpm") == 0, 1).otherwise(0))
    return islands(r, ["pump_id"], "timestamp", "f").select("pump_id", F.unix_seconds("first").alias("first_s"), F.unix_seconds("last").alias("last_s"), "rows", "open")


@query(
    "hour_gaps",
    f"""WITH {_R} SELECT pump_id, count(*) AS n, bool_and(coalesce(g, 1) = 1) AS contiguous FROM (SELECT pump_id, date_diff('hour', lag(ts) OVER (PARTITION BY pump_id ORDER BY ts, reading_id), ts) AS g FROM r) GROUP BY pump_id""",
)
def hour_gaps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("pump_id").orderBy("timestamp", "reading_id")
    g = _readings(spark, d).withColumn("g", (F.unix_seconds("timestamp") - F.unix_seconds(F.lag("timestamp").over(w))) / 3600)
    return g.groupBy("pump_id").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("g"), F.lit(1.0)) == 1).alias("contiguous"))


@query(
    "snapshot_windows",
    f"""WITH {_R}, h AS (SELECT reading_id, pump_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h FROM r), o AS (SELECT pump_id, max(h) - 20 AS origin FROM h GROUP BY 1)
    SELECT h.pump_id, count(*) AS rows, min(h) AS lo, max(h) AS hi FROM h JOIN o ON h.pump_id = o.pump_id AND h.h > origin - 168 AND h.h <= origin GROUP BY h.pump_id HAVING count(DISTINCT h) = 168""",
)
def snapshot_windows(spark: SparkSession, d: str) -> DataFrame:
    h = _readings(spark, d).select("reading_id", "pump_id", F.floor(F.unix_seconds("timestamp") / 3600).alias("h"))
    o = h.groupBy("pump_id").agg((F.max("h") - 20).alias("origin")).withColumn("snapshot", F.col("pump_id"))
    return complete_windows(h, o, "pump_id", "h", 168).groupBy("pump_id").agg(F.count("*").alias("rows"), F.min("h").alias("lo"), F.max("h").alias("hi"))


@query(
    "labels_without_tail",
    f"""WITH {_R}, h AS (SELECT reading_id, pump_id, epoch(ts) AS t, max(epoch(ts)) OVER (PARTITION BY pump_id) AS mx FROM r), f AS (SELECT DISTINCT pump_id, CAST(epoch(failure_time) AS BIGINT) AS t FROM failure_log)
    SELECT pump_id, count(*) AS n, CAST(sum(CAST(EXISTS (SELECT 1 FROM f WHERE f.pump_id = h.pump_id AND f.t > h.t AND f.t <= h.t + 172800) AS INTEGER)) AS BIGINT) AS positive FROM h WHERE t <= mx - 172800 GROUP BY pump_id""",
)
def labels_without_tail(spark: SparkSession, d: str) -> DataFrame:
    from shoal.operators.joins import event_within

    r = _readings(spark, d).select("reading_id", "pump_id", F.unix_seconds("timestamp").alias("t"))
    last = r.groupBy("pump_id").agg(F.max("t").alias("mx"))
    r = r.join(last, "pump_id").filter(F.col("t") <= F.col("mx") - 172_800)
    f = table(spark, d, "failure_log").select("pump_id", F.unix_seconds("failure_time").alias("t"))
    return event_within(r, f, "pump_id", "t", "t", 172_800).groupBy("pump_id").agg(F.count("*").alias("n"), F.sum("label").alias("positive"))


# ---------------------------------------------------------------- recency, shares, kernels


@query(
    "recent_event_counts",
    """SELECT user_id, count(*) FILTER (event_type = 'view' AND ts >= TIMESTAMP '2024-01-23') AS n_view, count(*) FILTER (event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-23') AS n_purchase FROM events GROUP BY user_id""",
)
def recent_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return recent_counts(table(spark, d, "events"), ["user_id"], "event_type", ["view", "purchase"], F.col("ts") >= F.lit("2024-01-23").cast("timestamp_ntz"))


@query(
    "dueness_by_user_item",
    """WITH e AS (SELECT user_id, event_type, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 2) AS BIGINT) AS wk FROM events WHERE event_type IN ('purchase', 'signup')),
    g AS (SELECT user_id, event_type, count(DISTINCT wk) AS weeks, min(wk) AS first, max(wk) AS last FROM e GROUP BY 1, 2),
    h AS (SELECT *, CASE WHEN weeks > 1 THEN (last - first) / (weeks - 1) END AS gap FROM g), m AS (SELECT event_type, median(gap) AS med FROM h WHERE gap > 0 GROUP BY 1),
    k AS (SELECT h.*, greatest(coalesce(CASE WHEN gap > 0 THEN gap END, med, 2.0), 0.5) AS gf FROM h LEFT JOIN m USING (event_type))
    SELECT user_id, event_type, weeks, round(gf, 6) AS gap, round(least(greatest((14 + 1 - last) / gf, 0), 4), 6) AS due FROM k""",
)
def dueness_by_user_item(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "signup"))
    e = e.withColumn("wk", F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 2))
    return dueness(e, ["user_id", "event_type"], "wk", 14).select("user_id", "event_type", "weeks", F.round("gap", 6).alias("gap"), F.round("due", 6).alias("due"))


@query("type_shares", "SELECT user_id, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM events GROUP BY 1, 2")
def type_shares(spark: SparkSession, d: str) -> DataFrame:
    return share_of_total(table(spark, d, "events"), ["user_id", "event_type"], ["user_id"]).withColumn("share", F.round("share", 6))


@query(
    "price_kernel",
    """WITH m AS (SELECT p_brand, median(p_retailprice) AS c FROM part GROUP BY 1) SELECT p_partkey, round(exp(-0.5 * pow((ln(p_retailprice) - ln(c)) / 0.7, 2)), 6) AS k FROM part JOIN m USING (p_brand)""",
)
def price_kernel(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    m = p.groupBy("p_brand").agg(F.median("p_retailprice").alias("c"))
    return p.join(m, "p_brand").select("p_partkey", F.round(gaussian_kernel(F.col("p_retailprice"), F.col("c"), 0.7), 6).alias("k"))


@query(
    "history_decay",
    """SELECT o_custkey, round(sum(pow(0.5, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') / 60.0)), 6) AS weight, CAST(date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-08-02') AS INTEGER) AS age FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-02' GROUP BY 1""",
)
def history_decay(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter(F.col("o_orderdate") < F.lit("2001-08-02").cast("timestamp_ntz"))
    age = F.datediff(F.lit("2001-08-02").cast("date"), F.to_date("o_orderdate"))
    return o.groupBy("o_custkey").agg(F.round(F.sum(half_life(age, 60.0)), 6).alias("weight"), F.min(age).alias("age"))


@query(
    "banded_support",
    """SELECT l_partkey, count(DISTINCT l_orderkey) FILTER (a >= 0 AND a < 90) AS d90, count(DISTINCT l_orderkey) FILTER (a >= 90 AND a < 180) AS d180, count(DISTINCT l_orderkey) FILTER (a >= 0 AND a < 365) AS d365
    FROM (SELECT l_partkey, l_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-01-01') AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1 HAVING count(*) FILTER (a >= 0 AND a < 365) > 0""",
)
def banded_support(spark: SparkSession, d: str) -> DataFrame:
    a = F.datediff(F.lit("2001-01-01").cast("date"), F.to_date("o_orderdate"))
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "l_orderkey", a.alias("a")).filter("a >= 0 AND a < 365")

    def n(lo: int, hi: int):
        return F.count_distinct(F.when((F.col("a") >= lo) & (F.col("a") < hi), F.col("l_orderkey")))

    return j.groupBy("l_partkey").agg(n(0, 90).alias("d90"), n(90, 180).alias("d180"), n(0, 365).alias("d365"))


@query("hash_folds", "SELECT c_custkey, CAST(('0x' || substr(sha256('fold:' || CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 4 AS fold FROM customer")
def hash_folds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", hash_fold(F.col("c_custkey"), 4).alias("fold"))


@query(
    "quantile_mapping",
    """WITH k(x, y) AS (VALUES (0.1, 1.0), (0.5, 3.0), (0.9, 10.0)), p AS (SELECT s_suppkey, (s_suppkey % 101) / 100.0 AS v FROM supplier)
    SELECT s_suppkey, round(CASE WHEN v < 0.1 THEN 1.0 WHEN v >= 0.9 THEN 10.0 WHEN v < 0.5 THEN 1 + 2 * (v - 0.1) / 0.4 ELSE 3 + 7 * (v - 0.5) / 0.4 END, 6) AS mapped FROM p""",
)
def quantile_mapping(spark: SparkSession, d: str) -> DataFrame:
    knots = spark.createDataFrame([(0.1, 1.0), (0.5, 3.0), (0.9, 10.0)], "x double, y double")
    p = table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 101) / 100.0).alias("v"))
    return quantile_map(p, "v", knots).select("s_suppkey", F.round("mapped", 6).alias("mapped"))


# ---------------------------------------------------------------- bars and rules

_BARS = """b0 AS (SELECT o_orderpriority AS arena, date_trunc('week', o_orderdate) AS bar, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2),
bars AS (SELECT *, CAST(row_number() OVER (PARTITION BY arena ORDER BY bar) - 1 AS INTEGER) AS step FROM b0)"""
_W = "(PARTITION BY arena ORDER BY step)"
IN_SAMPLE = 200


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return B.resample(table(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice", unit="week")


@query("ohlc_bars", f"WITH {_BARS} SELECT arena, step, open, high, low, close, volume FROM bars")
def ohlc_bars(spark: SparkSession, d: str) -> DataFrame:
    return _bars(spark, d).select("arena", "step", "open", "high", "low", "close", "volume")


@query(
    "contiguous_bars",
    f"""WITH {_BARS}, g AS (SELECT *, date_diff('day', lag(bar) OVER (PARTITION BY arena ORDER BY bar), bar) AS g FROM bars)
    SELECT arena, count(*) AS n FROM g GROUP BY arena HAVING count(*) >= 2 AND bool_and(coalesce(g, 7) = 7) AND bool_and(low > 0 AND volume > 0 AND high >= low)""",
)
def contiguous_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.contiguous_arenas(_bars(spark, d), 7)


@query(
    "normalised_bars",
    f"""WITH {_BARS}, m AS (SELECT arena, median(volume) FILTER (step < {IN_SAMPLE}) AS med FROM bars GROUP BY 1), f AS (SELECT arena, close AS c0 FROM bars WHERE step = 0)
    SELECT arena, step, round(close / c0, 6) AS close, round(volume / med, 6) AS volume FROM bars JOIN m USING (arena) JOIN f USING (arena)""",
)
def normalised_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.normalised(_bars(spark, d), IN_SAMPLE).select("arena", "step", F.round("close", 6).alias("close"), F.round("volume", 6).alias("volume"))


_REGIME = f"""x AS (SELECT *, coalesce(close / lag(close) OVER {_W} - 1, 0) AS ret, coalesce(ln(close / lag(close) OVER {_W}), 0) AS logret FROM bars),
v AS (SELECT *, CASE WHEN step >= 5 THEN stddev_pop(logret) OVER (PARTITION BY arena ORDER BY step ROWS 4 PRECEDING) END AS vol FROM x),
q AS (SELECT arena, quantile_cont(vol, 0.6) FILTER (step < {IN_SAMPLE}) AS thr FROM v GROUP BY 1), rg AS (SELECT v.*, CAST(coalesce(vol >= thr - 1e-12, false) AS INTEGER) AS high_vol FROM v JOIN q USING (arena))"""


def _regime(spark: SparkSession, d: str) -> DataFrame:
    return B.with_regime(_bars(spark, d), 5, 0.6, IN_SAMPLE)


@query("volatility_regime", f"WITH {_BARS}, {_REGIME} SELECT arena, step, round(ret, 6) AS ret, round(vol, 6) AS vol, high_vol FROM rg")
def volatility_regime(spark: SparkSession, d: str) -> DataFrame:
    return _regime(spark, d).select("arena", "step", F.round("ret", 6).alias("ret"), F.round("vol", 6).alias("vol"), "high_vol")


_TREND = f"""tr AS (SELECT arena, step, close, CAST(coalesce(CASE WHEN count(*) OVER a >= 4 THEN avg(close) OVER a END > CASE WHEN count(*) OVER b >= 12 THEN avg(close) OVER b END, false) AS INTEGER) AS pos
FROM bars WINDOW a AS (PARTITION BY arena ORDER BY step ROWS 3 PRECEDING), b AS (PARTITION BY arena ORDER BY step ROWS 11 PRECEDING))"""


def _trend(spark: SparkSession, d: str) -> DataFrame:
    return _regime(spark, d).withColumn("pos", B.trend_position(4, 12))


@query("trend_positions", f"WITH {_BARS}, {_TREND} SELECT arena, step, pos FROM tr")
def trend_positions(spark: SparkSession, d: str) -> DataFrame:
    return _trend(spark, d).select("arena", "step", "pos")


_STATE = "coalesce(last_value(CASE WHEN {i} THEN 1 WHEN {o} THEN 0 END IGNORE NULLS) OVER (PARTITION BY arena ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"


@query(
    "breakout_positions",
    f"""WITH {_BARS}, x AS (SELECT *, max(high) OVER (PARTITION BY arena ORDER BY step ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS hh, min(low) OVER (PARTITION BY arena ORDER BY step ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS ll FROM bars)
    SELECT arena, step, {_STATE.format(i="step >= 6 AND close > hh", o="step >= 3 AND close < ll")} AS pos FROM x""",
)
def breakout_positions(spark: SparkSession, d: str) -> DataFrame:
    return B.breakout_position(_bars(spark, d), 6, 3).select("arena", "step", "pos")


@query(
    "reversion_positions",
    f"""WITH {_BARS}, x AS (SELECT *, CASE WHEN step >= 9 THEN (close - avg(close) OVER w) / nullif(stddev_pop(close) OVER w, 0) END AS z FROM bars WINDOW w AS (PARTITION BY arena ORDER BY step ROWS 9 PRECEDING))
    SELECT arena, step, {_STATE.format(i="z < -1.2", o="z > -0.2")} AS pos FROM x""",
)
def reversion_positions(spark: SparkSession, d: str) -> DataFrame:
    return B.reversion_position(_bars(spark, d), 10, 1.2, 0.2).select("arena", "step", "pos")


@query(
    "calm_momentum_positions",
    f"""WITH {_BARS}, x AS (SELECT *, coalesce(ln(close / lag(close) OVER {_W}), 0) AS lr, lag(close, 6) OVER {_W} AS l6 FROM bars), v AS (SELECT *, CASE WHEN step >= 7 THEN stddev_pop(lr) OVER (PARTITION BY arena ORDER BY step ROWS 7 PRECEDING) END AS v FROM x),
    q AS (SELECT arena, quantile_cont(v, 0.45) FILTER (step < {IN_SAMPLE}) AS thr FROM v GROUP BY 1) SELECT arena, step, CAST(coalesce(v < thr AND close > l6, false) AS INTEGER) AS pos FROM v JOIN q USING (arena)""",
)
def calm_momentum_positions(spark: SparkSession, d: str) -> DataFrame:
    return B.calm_momentum_position(_bars(spark, d), 8, 0.45, 6, IN_SAMPLE).select("arena", "step", "pos")


_TRADES = f"""g AS (SELECT *, step - row_number() OVER (PARTITION BY arena, pos ORDER BY step) AS grp, max(step) OVER (PARTITION BY arena) AS mx FROM tr),
tg AS (SELECT arena, min(step) AS entry_step, CASE WHEN max(step) = max(mx) THEN max(step) ELSE max(step) + 1 END AS exit_step, CAST(max(step) = max(mx) AS INTEGER) AS open_at_cutoff FROM g WHERE pos = 1 GROUP BY arena, grp),
td AS (SELECT tg.*, b.close / a.close - 1 AS trade_return FROM tg JOIN bars a ON a.arena = tg.arena AND a.step = entry_step JOIN bars b ON b.arena = tg.arena AND b.step = exit_step)"""


@query("trade_log", f"WITH {_BARS}, {_TREND}, {_TRADES} SELECT arena, entry_step, exit_step, open_at_cutoff, round(trade_return, 6) AS trade_return FROM td")
def trade_log(spark: SparkSession, d: str) -> DataFrame:
    return B.trades(_trend(spark, d)).withColumn("trade_return", F.round("trade_return", 6))


@query(
    "trade_days_profit",
    f"""WITH {_BARS}, {_TREND}, {_TRADES}, e AS (SELECT arena, unnest(range(entry_step, exit_step)) AS step FROM td), r AS (SELECT arena, step, coalesce(close / lag(close) OVER {_W} - 1, 0) AS ret FROM bars)
    SELECT e.arena, count(*) AS days, round(sum(r.ret), 6) AS gained FROM e JOIN r ON r.arena = e.arena AND r.step = e.step + 1 GROUP BY 1""",
)
def trade_days_profit(spark: SparkSession, d: str) -> DataFrame:
    from shoal.operators.joins import expand_steps

    x = _trend(spark, d)
    e = expand_steps(B.trades(x), "entry_step", "exit_step").select("arena", (F.col("step") + 1).alias("step"))
    return e.join(x.select("arena", "step", "ret"), ["arena", "step"]).groupBy("arena").agg(F.count("*").alias("days"), F.round(F.sum("ret"), 6).alias("gained"))


_PNL = f"p AS (SELECT arena, step, pos, coalesce(lag(pos) OVER {_W} * (close / lag(close) OVER {_W} - 1), 0) AS pnl FROM tr)"


@query(
    "quarter_sharpes",
    f"""WITH {_BARS}, {_TREND}, {_PNL}, n AS (SELECT arena, pnl, ntile(4) OVER {_W} AS quarter FROM p WHERE step > 0)
    SELECT arena, CAST(quarter AS INTEGER) AS quarter, round(CASE WHEN stddev_pop(pnl) > 0 THEN avg(pnl) / stddev_pop(pnl) * sqrt(365) ELSE 0 END, 5) AS sharpe FROM n GROUP BY 1, 2""",
)
def quarter_sharpes(spark: SparkSession, d: str) -> DataFrame:
    return B.quarter_sharpe(B.profit(_trend(spark, d))).withColumn("sharpe", F.round("sharpe", 5))


@query(
    "drawdowns",
    f"""WITH {_BARS}, {_TREND}, {_PNL}, e AS (SELECT *, sum(pnl) OVER (PARTITION BY arena ORDER BY step) AS eq, lag(pnl) OVER {_W} AS l FROM p), m AS (SELECT *, max(eq) OVER (PARTITION BY arena ORDER BY step) - eq AS dd FROM e)
    SELECT arena, round(sum(pnl), 6) + 0.0 AS total, round(max(dd), 6) + 0.0 AS drawdown, round(coalesce(corr(pnl, l), 0), 6) + 0.0 AS autocorrelation FROM m GROUP BY 1""",
)
def drawdowns(spark: SparkSession, d: str) -> DataFrame:
    x = B.drawdown(B.profit(_trend(spark, d)))
    return x.select("arena", *[(F.round(c, 6) + 0.0).alias(c) for c in ("total", "drawdown", "autocorrelation")])


@query(
    "strategy_behaviour",
    f"""WITH {_BARS}, {_REGIME}, {_TREND}, {_TRADES}, {_PNL}, s AS (SELECT p.arena, avg(p.pos) AS exposure, sum(CASE WHEN p.pos = 1 AND coalesce(lp, 0) = 0 THEN 1 ELSE 0 END) AS entries FROM (SELECT *, lag(pos) OVER {_W} AS lp FROM p) p GROUP BY 1),
    t AS (SELECT td.arena, count(*) AS n_trades, avg(greatest(exit_step - entry_step, 1)) AS mean_duration, avg(CASE WHEN trade_return > 0 THEN 1.0 ELSE 0 END) AS win_rate,
      coalesce(avg(CASE WHEN trade_return > 0 THEN 1.0 ELSE 0 END) FILTER (high_vol = 1), 0.5) AS win_high, coalesce(avg(CASE WHEN trade_return > 0 THEN 1.0 ELSE 0 END) FILTER (high_vol = 0), 0.5) AS win_low FROM td JOIN rg ON rg.arena = td.arena AND rg.step = entry_step GROUP BY 1)
    SELECT arena, round(exposure, 6) AS exposure, CAST(entries AS BIGINT) AS entries, n_trades, round(mean_duration, 6) AS mean_duration, round(win_rate, 6) AS win_rate, round(win_high, 6) AS win_high, round(win_low, 6) AS win_low FROM s JOIN t USING (arena)""",
)
def strategy_behaviour(spark: SparkSession, d: str) -> DataFrame:
    x = B.profit(_trend(spark, d))
    b = B.behaviour(x, B.trades(x))
    return b.select("arena", F.round("exposure", 6).alias("exposure"), "entries", "n_trades", *[F.round(c, 6).alias(c) for c in ("mean_duration", "win_rate", "win_high", "win_low")])


@query(
    "sample_split_sharpe",
    f"""WITH {_BARS}, {_TREND}, {_PNL} SELECT arena, round(CASE WHEN a > 0 THEN least(greatest(am / a * sqrt(365), -10), 10) ELSE 0 END, 5) AS in_sample, round(CASE WHEN b > 0 THEN least(greatest(bm / b * sqrt(365), -10), 10) ELSE 0 END, 5) AS out_of_sample FROM
    (SELECT arena, stddev_pop(pnl) FILTER (step > 0 AND step < {IN_SAMPLE}) AS a, avg(pnl) FILTER (step > 0 AND step < {IN_SAMPLE}) AS am, stddev_pop(pnl) FILTER (step >= {IN_SAMPLE}) AS b, avg(pnl) FILTER (step >= {IN_SAMPLE}) AS bm FROM p GROUP BY 1)""",
)
def sample_split_sharpe(spark: SparkSession, d: str) -> DataFrame:
    from shoal.operators.aggregates import sharpe

    x, s = B.profit(_trend(spark, d)), F.col("step")
    return x.groupBy("arena").agg(
        F.round(sharpe(F.when((s > 0) & (s < IN_SAMPLE), F.col("pnl"))), 5).alias("in_sample"), F.round(sharpe(F.when(s >= IN_SAMPLE, F.col("pnl"))), 5).alias("out_of_sample")
    )
