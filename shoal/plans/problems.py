"""The pN_ queries of the general problems, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.operators.intervals import downtimes, merge_intervals
from shoal.operators.loglines import log_entries
from shoal.operators.spikes import implausible_readings, source_tails
from shoal.operators.stamps import resolve_stamps, source_mixtures, stamp_readings
from shoal.operators.units import common_units, reading_units, readings
from shoal.session import materialized
from shoal.streaming.redelivery import delivery_kinds, find_redeliveries


MESSAGE = {
    "key": ["user_id", "item_id", "event_type", "timestamp"],
    "event_time": "timestamp",
    "arrived": "received_at",
    "row_id": "row_id",
    "required": ["user_id", "timestamp"],
}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """row_id of each delivery of a shopper message but its first."""
    return find_redeliveries(spark, f"{d}/rr_train.parquet", **MESSAGE)


def p1_store(spark: SparkSession, d: str) -> DataFrame:
    """How many rows the store settled as repeats, set aside as late, and let go to the archive."""
    kind = F.element_at(F.array(F.lit("repeat"), F.lit("late"), F.lit("expired")), F.col("kind"))
    return delivery_kinds(spark, f"{d}/rr_train.parquet", **MESSAGE).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


P1_SQL = r"""
SELECT row_id FROM (
  SELECT row_id, row_number() OVER (
    PARTITION BY regexp_replace(lower(user_id), '^\s+|\s+$', '', 'g'),
                 regexp_replace(lower(item_id), '^\s+|\s+$', '', 'g'),
                 regexp_replace(lower(event_type), '^\s+|\s+$', '', 'g'), "timestamp"
    ORDER BY received_at, row_id) AS rn
  FROM rr_train WHERE user_id IS NOT NULL AND "timestamp" IS NOT NULL) WHERE rn > 1
"""

def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Level, component and message of each undamaged log entry."""
    return log_entries(_table(spark, d, "bg_train")).filter("ok").select("line_id", "level", "component", "message")


def p2_unparsed(spark: SparkSession, d: str) -> DataFrame:
    """Entries that fit no layout, with the span that no rule explains."""
    return log_entries(_table(spark, d, "bg_train")).filter("NOT ok").select("line_id", "stream", "line_no", "unparsed")


def _downtime(spark: SparkSession, d: str) -> DataFrame:
    return merge_intervals(downtimes(_table(spark, d, "failure_log")), "pump_id", "start_s", "end_s").filter("kind = 'down'")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Impossible, stuck and spiking readings of each pump."""
    return implausible_readings(_table(spark, d, "sensor_readings"), _downtime(spark, d))


def p3_tails(spark: SparkSession, d: str) -> DataFrame:
    """The tail fitted to each pump's residuals, and the cutoff it sets."""
    t = source_tails(_table(spark, d, "sensor_readings"), _downtime(spark, d))
    return t.select("pump_id", "channel", "n", *[F.round(c, 6).alias(c) for c in ("threshold", "scale", "shape", "faults", "cut")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Temperature and pressure of each undamaged entry in tenths of a degree Celsius and of a kPa."""
    read = materialized(readings(log_entries(_table(spark, d, "bg_train")).filter("ok")), "readings")
    return common_units(read, reading_units(read, _table(spark, d, "streams")))


def p5_units(spark: SparkSession, d: str) -> DataFrame:
    """The unit found for each stream's numbers without one, its log residual, and whether it is unique."""
    read = materialized(readings(log_entries(_table(spark, d, "bg_train")).filter("ok")), "readings")
    return reading_units(read, _table(spark, d, "streams")).filter("residual IS NOT NULL").withColumn("residual", F.round("residual", 6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous downtimes of each pump and the gaps between them."""
    return merge_intervals(downtimes(_table(spark, d, "failure_log")), "pump_id", "start_s", "end_s")


P6_SQL = """
WITH iv AS (
  SELECT pump_id, CAST(epoch(failure_time) AS BIGINT) AS s,
         CAST(epoch(failure_time) AS BIGINT) + CAST(downtime_hours AS BIGINT) * 3600 AS t
  FROM failure_log WHERE pump_id IS NOT NULL AND failure_time IS NOT NULL AND downtime_hours > 0),
m AS (SELECT *, max(t) OVER (PARTITION BY pump_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY pump_id ORDER BY s, t) AS grp FROM m),
p AS (SELECT pump_id, grp, min(s) AS start_s, max(t) AS end_s FROM g GROUP BY pump_id, grp)
SELECT pump_id, 'down' AS kind, start_s, end_s FROM p
UNION ALL
SELECT pump_id, 'gap', end_s, nxt FROM (SELECT *, lead(start_s) OVER (PARTITION BY pump_id ORDER BY start_s) AS nxt FROM p) WHERE nxt IS NOT NULL
"""


def _stamps(spark: SparkSession, d: str) -> DataFrame:
    entries = log_entries(_table(spark, d, "bg_train")).filter("ok")
    read = materialized(stamp_readings(entries, _table(spark, d, "streams"), _table(spark, d, "sites")), "stamps")
    return resolve_stamps(read, source_mixtures(read))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The UTC instant of each undamaged entry whose instant can be told."""
    return _stamps(spark, d).filter("utc_ms IS NOT NULL").select("line_id", "utc_ms")


def p7_unresolved(spark: SparkSession, d: str) -> DataFrame:
    """Stamps of which two readings stay about equally likely."""
    return _stamps(spark, d).filter("unresolved").select("line_id", F.round("posterior", 6).alias("posterior"))


QUERIES = {
    "p1_found": p1_found,
    "p1_store": p1_store,
    "p2_found": p2_found,
    "p2_unparsed": p2_unparsed,
    "p3_found": p3_found,
    "p3_tails": p3_tails,
    "p5_found": p5_found,
    "p5_units": p5_units,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_unresolved": p7_unresolved,
}
SQL = {"p1_found": P1_SQL, "p6_found": P6_SQL}
