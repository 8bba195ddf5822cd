"""Overlapping, nested and gapped intervals per entity: continuous periods and the gaps between.

The intervals are sorted over the whole cluster by (entity, start) with a range partitioning, so that an
entity of any size is spread over as many partitions as it needs. Each partition is
summarised in one row: its last entity, the start of that entity's last period and its largest end.
Combining the summaries in partition order gives every partition the period that is still
open where it begins. A second scan, with that period as its starting state, labels the periods.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.session import checkpointed

_SUMMARY = "pid int, first_entity string, entity string, single boolean, start long, end long"


def _runs(pdf: pd.DataFrame) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Consecutive rows of one entity: (entity, starts, ends)."""
    e = pdf["entity"].to_numpy()
    s, t = pdf["s"].to_numpy(), pdf["t"].to_numpy()
    cut = np.flatnonzero(e[1:] != e[:-1]) + 1
    for a, b in zip([0, *cut], [*cut, len(e)]):
        yield e[a], s[a:b], t[a:b]


def _scan(batches: Iterator[pd.DataFrame], carry: tuple | None) -> Iterator[tuple[tuple | None, list[tuple]]]:
    """Walk sorted rows. Yields, per batch, the open period (entity, start, end) and the rows that are settled:
    ("down", entity, start, end) pieces of periods and ("gap", entity, end, next start)."""
    open_ = carry
    for pdf in batches:
        out = []
        for entity, s, t in _runs(pdf):
            reach = np.maximum.accumulate(t)
            if open_ is not None and open_[0] == entity:
                reach = np.maximum(reach, open_[2])
                before = np.concatenate([[open_[2]], reach[:-1]])
            else:
                before = np.concatenate([[np.iinfo(np.int64).min], reach[:-1]])
            new = s > before
            if open_ is not None and open_[0] != entity:
                out.append(("down", *open_))
                open_ = None
            at = np.flatnonzero(new)
            if open_ is not None and (not len(at) or at[0] > 0):
                open_ = (entity, open_[1], int(reach[(at[0] if len(at) else len(s)) - 1]))
            for k, i in enumerate(at):
                if open_ is not None:
                    out.append(("down", *open_))
                    out.append(("gap", entity, open_[2], int(s[i])))
                open_ = (entity, int(s[i]), int(reach[(at[k + 1] if k + 1 < len(at) else len(s)) - 1]))
        yield open_, out


def merge_intervals(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, kind, start_s, end_s) of each continuous period ("down") and each gap between two of an entity ("gap").

    start and end are longs; an interval covers start up to, not including, end. Intervals that only
    touch are one period. Rows with a null entity, start or end, or with end <= start, cover nothing.
    Repeated rows change nothing; an empty table gives no rows.
    """
    rows = (
        df.select(F.col(entity).cast("string").alias("entity"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("t"))
        .filter("entity IS NOT NULL AND s IS NOT NULL AND t > s")
        # copies of an interval collapse before the shuffle; a start keeps its longest interval
        .groupBy("entity", "s")
        .agg(F.max("t").alias("t"))
    )
    # both scans must see the same partitions, so the sorted rows are checkpointed
    ordered = checkpointed(rows.repartitionByRange("entity", "s").sortWithinPartitions("entity", "s"))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, open_, single = None, None, True

        def named():
            nonlocal first
            for pdf in batches:
                if len(pdf):
                    if first is None:
                        first = pdf["entity"].iloc[0]
                    yield pdf

        for open_, _ in _scan(named(), None):
            pass
        if open_ is not None:
            single = open_[0] == first
            yield pd.DataFrame([(TaskContext.get().partitionId(), first, open_[0], single, open_[1], open_[2])], columns=["pid", "first_entity", "entity", "single", "start", "end"])

    # one row a partition: bounded by the number of partitions, whatever the data
    summaries = sorted(ordered.mapInPandas(summarise, _SUMMARY).collect())
    carry, into = None, {}
    for r in summaries:
        into[r.pid] = carry
        if carry is not None and r.single and r.entity == carry[0] and r.start <= carry[2]:
            carry = (carry[0], carry[1], max(carry[2], r.end))
        else:
            carry = (r.entity, r.start, r.end)
    # where the next partition goes on with the entity, the open period is left to it
    after = {a.pid: b.first_entity for a, b in zip(summaries, summaries[1:])}

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        names = ["kind", "entity", "start_s", "end_s"]
        open_ = into.get(pid)
        for open_, out in _scan((b for b in batches if len(b)), open_):
            if out:
                yield pd.DataFrame(out, columns=names)
        if open_ is not None and pid in into and after.get(pid) != open_[0]:
            yield pd.DataFrame([("down", *open_)], columns=names)

    return ordered.mapInPandas(label, "kind string, entity string, start_s long, end_s long").select(
        F.col("entity").alias(entity), "kind", "start_s", "end_s"
    )


def downtimes(failures: DataFrame) -> DataFrame:
    """failure_log rows as intervals (pump_id, start_s, end_s) in epoch seconds."""
    s = F.unix_seconds("failure_time")
    return failures.select("pump_id", s.alias("start_s"), (s + F.col("downtime_hours").cast("long") * 3600).alias("end_s"))
