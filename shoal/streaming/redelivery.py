"""Messages delivered more than once: keep the first delivery of each.

A keyed state store of seen identifiers runs under Structured Streaming. Its keys are a message's slot of event time
(a day) and a hash bucket; a key's state is one packed table of (identifier hash, first arrival, first row, event time), so that a
commit touches the slots its messages fall into and no others. A slot expires as a whole, by a timer, once the event-time watermark has
passed its end; its identifiers then go to an archive table. A delivery of an expired slot
is not decided by the store: it is set aside and looked up in that archive after
the run. Progress, state and output are committed together by the stream's checkpoint and
the file sink's log, so a lost executor or a restart neither drops nor repeats a row. The store is RocksDB, off the heap.

A table is streamed in the order of arrival, in a number of commits: it is written once, narrow, by ranges of arrival.

Which copy is first depends on (arrival, row id) alone, not on the order of processing: when
an earlier copy turns up later, the copy that was kept so far is reported in its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from shoal.functions.text import folded, key128
from shoal.session import scratch_path

FRESH, REPEAT, LATE, EXPIRED, TICK = 0, 1, 2, 3, 4
#: Commits a table is streamed in. Raise it with the table: a commit's messages pass the shuffle at once.
COMMITS = 10
#: Length of a slot of event time.
SLOT_MS = 86_400_000
#: The state store: on disk and off the heap, with changes written at a commit, not the whole.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
ENTRY = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("arrived", "<i8"), ("row_id", "<i8"), ("event_ms", "<i8")])
OUT = "kind int, h1 long, h2 long, arrived long, row_id long"


def _split_first(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first entry of each identifier, all others)."""
    e = e[np.lexsort((e["row_id"], e["arrived"], e["h2"], e["h1"]))]
    first = np.ones(len(e), bool)
    first[1:] = (e["h1"][1:] != e["h1"][:-1]) | (e["h2"][1:] != e["h2"][:-1])
    return e[first], e[~first]


def _entries(pdf: pd.DataFrame) -> np.ndarray:
    e = np.empty(len(pdf), ENTRY)
    for c in ENTRY.names:
        e[c] = pdf[c].to_numpy()
    return e


def _frame(kind: int, e: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(e), kind, np.int32), **{c: e[c] for c in ("h1", "h2", "arrived", "row_id")}})


def _thin(buckets: int):
    """Settle repeats within an Arrow batch before the shuffle, so that a hot message stays small.

    The losers are certain repeats; they travel on under a bucket of their own row id, spread evenly. The event time that
    moves the watermark travels on a row of its own: the stateful operator would drop late rows that carry one, and they have to be looked up.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            keep, lost = _split_first(_entries(pdf))
            for kind, e in ((FRESH, keep), (REPEAT, lost)):
                if len(e):
                    out = _frame(kind, e)
                    out["event_ms"] = e["event_ms"]
                    out["event_time"] = pd.Series(pd.NaT, out.index, dtype="datetime64[us, UTC]")
                    out["slot"] = e["event_ms"] // SLOT_MS
                    out["bucket"] = ((e["h1"] if kind == FRESH else e["row_id"]) % buckets).astype(np.int32)
                    yield out
            newest = max(int(e["event_ms"].max()) for e in (keep, lost) if len(e))
            tick = _frame(TICK, np.zeros(1, ENTRY)).assign(event_ms=newest, event_time=pd.to_datetime([newest], unit="ms", utc=True), slot=newest // SLOT_MS, bucket=np.int32(0))
            yield tick[out.columns.tolist()]

    return run


def _step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    end = (int(key[1]) + 1) * SLOT_MS
    seen = np.frombuffer(state.get[0], ENTRY) if state.exists else np.empty(0, ENTRY)
    if state.hasTimedOut:
        state.remove()
        if len(seen):
            yield _frame(EXPIRED, seen)
        return
    mark = state.getCurrentWatermarkMs()
    new, out = [], []
    for pdf in batches:
        kind = pdf["kind"].to_numpy()
        e = _entries(pdf)
        out.append(_frame(REPEAT, e[kind == REPEAT]))
        new.append(e[kind == FRESH])
    e = np.concatenate(new)
    if not len(e):
        pass
    elif end <= mark and not state.exists:
        # the slot has expired, or never was: the archive knows
        out.append(_frame(LATE, e))
    else:
        keep, lost = _split_first(np.concatenate([seen, e]))
        out.append(_frame(REPEAT, lost))
        if end <= mark:
            out.append(_frame(EXPIRED, keep))
            state.remove()
        else:
            state.update((keep.tobytes(),))
            state.setTimeoutTimestamp(end)
    for f in out:
        if len(f):
            yield f


def first_deliveries_stream(stream: DataFrame, delay: str = "3 days", buckets: int = 64) -> DataFrame:
    """The stateful part: rows (kind, h1, h2, arrived, row_id) of kind REPEAT, LATE or EXPIRED.

    stream holds h1, h2 (identifier hash), arrived (long), row_id (long), event_ms (long).
    delay is how far behind the newest event time an identifier's slot may end before it leaves the state store.
    """
    thin = stream.select(*ENTRY.names).mapInPandas(_thin(buckets), f"{OUT}, event_ms long, event_time timestamp, slot long, bucket int")
    return (
        thin.withWatermark("event_time", delay)
        .groupBy("bucket", "slot")
        .applyInPandasWithState(_step, OUT, "seen binary", "append", GroupStateTimeout.EventTimeTimeout)
    )


def late_lookup(out: DataFrame) -> DataFrame:
    """row_id of every repeat: those the store settled, and late ones settled against the archive."""
    late = out.filter(F.col("kind") == LATE)
    keys = late.select("h1", "h2").distinct()
    pool = late.unionByName(out.filter(F.col("kind") == EXPIRED).join(keys, ["h1", "h2"], "left_semi"))
    # min() combines on the map side, so an identifier with very many late copies is never gathered
    first = pool.groupBy("h1", "h2").agg(F.min(F.struct("arrived", "row_id")).alias("first"))
    lost = pool.join(first, ["h1", "h2"]).filter(F.struct("arrived", "row_id") != F.col("first"))
    return out.filter(F.col("kind") == REPEAT).select("row_id").unionByName(lost.select("row_id"))


def _in_order_of_arrival(rows: DataFrame, arrived: str, at: str, commits: int) -> int:
    """Write rows by ranges of arrival, one after the other, so that the file source reads them in that order; the number of files."""
    spark = rows.sparkSession
    cuts = rows.agg(F.percentile_approx(F.unix_micros(arrived), [i / commits for i in range(1, commits)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    when = F.col(arrived)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = F.lit(True) if low is None else when > F.timestamp_micros(F.lit(low))
        # rows without an arrival come last
        part = (when.isNull() if high is None and low is None else part & (when <= F.timestamp_micros(F.lit(high)))) if high is not None else (part | when.isNull())
        rows.filter(part).select(*ENTRY.names).write.mode("append").parquet(at)
    return len(spark.read.schema("h1 long").parquet(at).inputFiles())


def delivery_kinds(
    spark: SparkSession,
    path: str,
    key: list[str],
    event_time: str,
    arrived: str,
    row_id: str,
    required: list[str],
    delay: str = "3 days",
    buckets: int | None = None,
    commits: int = COMMITS,
    **options: str,
) -> DataFrame:
    """What the store told of the deliveries: (kind, h1, h2, arrived, row_id) of kind REPEAT, LATE or EXPIRED. Arguments as in ``find_redeliveries``."""
    buckets = buckets or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    table = spark.read.parquet(path)
    schema = table.schema
    need = list(dict.fromkeys([*key, event_time, arrived, row_id]))
    as_key = [folded(c) if schema[c].dataType.typeName() == "string" else F.col(c) for c in key]
    h1, h2 = key128(*as_key)
    entry = {
        "h1": h1,
        "h2": h2,
        "arrived": F.coalesce(F.unix_micros(arrived), F.lit(2**62)),
        "row_id": F.col(row_id).cast("long"),
        "event_ms": F.unix_millis(event_time),
    }
    given = " AND ".join(f"`{c}` IS NOT NULL" for c in required)
    at = scratch_path(spark, "redelivery")
    if options:
        # a file stream takes folders or patterns; as a pattern the path may also name a single file
        source = spark.readStream.schema(T.StructType([schema[c] for c in need])).options(**options).parquet(f"{path[:-1]}[{path[-1]}]")
        rows = source.filter(given).select(*[c.alias(k) for k, c in entry.items()])
    else:
        # the raw arrival stays beside, for the scan to skip what is outside a range
        narrow = table.select(*need).filter(given).select(*[c.alias(k) for k, c in entry.items()], F.col(arrived).alias("_arrived"))
        files = _in_order_of_arrival(narrow, "_arrived", f"{at}/in", commits)
        plain = T.StructType([T.StructField(c, T.LongType()) for c in ENTRY.names])
        rows = spark.readStream.schema(plain).option("maxFilesPerTrigger", str(max(1, -(-files // commits)))).parquet(f"{at}/in")
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = (
            first_deliveries_stream(rows, delay, buckets)
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{at}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{at}/out")
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if query.exception():
        raise query.exception()
    return spark.read.schema(OUT).parquet(f"{at}/out")


def find_redeliveries(
    spark: SparkSession,
    path: str,
    key: list[str],
    event_time: str,
    arrived: str,
    row_id: str,
    required: list[str],
    delay: str = "3 days",
    buckets: int | None = None,
    commits: int = COMMITS,
    **options: str,
) -> DataFrame:
    """row_id of each delivery of a message but its first, over a folder or file of Parquet deliveries.

    Two rows are one message if the key columns agree, strings regardless of letter case and
    surrounding white space; a null agrees with a null only. Rows with null in a required column are no
    messages and never come out. Ties in arrival go to the smaller row id. An empty table gives no
    rows. The event time must be part of the key. The table is streamed in order of arrival, in ``commits`` commits or about as many; with options
    (maxFilesPerTrigger, maxBytesPerTrigger: input per commit) its files are streamed as they are. A key of the store
    holds its share of the identifiers of a slot, 40 bytes each: choose buckets so that it stays at some megabytes
    (a quarter of the shuffle partitions by default).
    """
    return late_lookup(delivery_kinds(spark, path, key, event_time, arrived, row_id, required, delay, buckets, commits, **options))
