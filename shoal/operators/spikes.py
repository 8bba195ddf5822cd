"""Implausible readings: impossible values, stuck values and spikes, relative to each source's own course.

A reading's residual is its distance from the readings before and after it, whichever is nearer, once the
source's daily season is taken off; a lasting change of level leaves one of the two near and is no spike.
Residuals are scaled by the source's noise. Peaks over a high threshold are fitted with a generalised
Pareto tail of free shape by maximum likelihood, mixed with a share of faults spread widely so that the spikes
themselves don't bend the fit; the tail sets each source's cutoff at a fixed risk per reading. The tail of all
sources counts as so many readings of every source, so those with few readings lean on it and those with many don't.

The fit needs only histograms of scaled residuals, which add up. A source of any length is cut into
blocks of hours, each with enough hours of its neighbours to judge its own readings.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.session import materialized, python_partitions

BLOCK_HOURS = 8192
HALO_HOURS = 240
OUTAGE = -999.0
#: Impossible outside (low, high): fixed values.
PLAUSIBLE = {"vibration_mm_s": (0.0, 100.0), "bearing_temp_c": (-60.0, 300.0), "rpm": (0.0, 10_000.0)}
STUCK_HOURS = 6
SPIKE_HOURS = 3
SIDE = 6
#: Histogram of |scaled residual|: BINS of width WIDTH, the last open.
BINS, WIDTH = 96, 0.125
CANDIDATE = 3.0
#: Share of residuals that are peaks, and the readings of a source that the tail of all sources counts for.
TAIL, LEAN = 0.1, 2000.0
#: Grid of the fit: shapes, scales, shares of faults among the peaks.
SHAPES = np.linspace(-0.5, 0.6, 23)
SCALES = np.geomspace(0.1, 4.0, 48)
FAULTS = np.array([0.0, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3])


@functools.lru_cache(maxsize=64)
def _tail_table(first: int) -> np.ndarray:
    """Log-probability of each bin from ``first`` on, under every (shape, scale, share of faults) of the grid."""
    edge = np.append(np.arange(BINS - first) * WIDTH, np.inf)
    shape, scale = SHAPES[:, None, None], SCALES[None, :, None]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        base = np.maximum(1 + shape * edge / scale, 0.0)
        beyond = np.where(np.abs(shape) < 1e-9, np.exp(-edge / scale), base ** (-1 / np.where(np.abs(shape) < 1e-9, 1.0, shape)))
    beyond[..., -1] = 0.0
    cell = beyond[..., :-1] - beyond[..., 1:]
    # faults lie anywhere: half of them beyond the last edge
    fault = np.full(BINS - first, 0.5 / (BINS - first - 1))
    fault[-1] = 0.5
    mixed = (1 - FAULTS)[:, None] * cell[:, :, None, :] + FAULTS[:, None] * fault
    return np.log(np.maximum(mixed, 1e-12)).reshape(-1, BINS - first)


def gpd_tail(hist: np.ndarray, pooled: np.ndarray, risk: float, tail: float = TAIL, lean: float = LEAN) -> tuple[float, float, float, float, float]:
    """(threshold, scale, shape, share of faults, cutoff) of a source's |scaled residuals|, given as a histogram.

    The cutoff is exceeded with probability ``risk``. The histogram of all sources counts as ``lean`` more readings, so there is a
    tail for any number of own readings. Where there are no readings at all, nothing is judged: nan, and a cutoff of 6.
    """
    total = pooled.sum()
    h = hist + (pooled * (lean / total) if total else 0.0)
    if not h.sum():
        return (float("nan"),) * 4 + (6.0,)
    # the bin edge with at most a share ``tail`` beyond it
    first = min(int(np.searchsorted(np.cumsum(h), (1 - tail) * h.sum())) + 1, BINS - 2)
    at = int((_tail_table(first) @ h[first:]).argmax())
    i, j, k = np.unravel_index(at, (len(SHAPES), len(SCALES), len(FAULTS)))
    shape, scale, faults = float(SHAPES[i]), float(SCALES[j]), float(FAULTS[k])
    m = risk / max(h[first:].sum() * (1 - faults) / h.sum(), risk)
    u = first * WIDTH
    return u, scale, shape, faults, u + (scale / shape * (m**-shape - 1) if abs(shape) > 1e-9 else -scale * np.log(m))


def gpd_cutoff(hist: np.ndarray, pooled: np.ndarray, risk: float) -> float:
    """The cutoff of ``gpd_tail``."""
    return gpd_tail(hist, pooled, risk)[4]


def _row_median(w: np.ndarray) -> np.ndarray:
    """Median of each row without its nans; nan for rows of nothing else. Sorting puts nans last."""
    n = (~np.isnan(w)).sum(axis=1)
    s = np.sort(w, axis=1)
    r = np.arange(len(w))
    m = (s[r, np.maximum((n - 1) // 2, 0)] + s[r, np.minimum(n // 2, w.shape[1] - 1)]) / 2
    return np.where(n > 0, m, np.nan)


def _sides(y: np.ndarray, seg: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median of up to SIDE readings before and after each, within its running segment."""
    n = len(y)
    z = np.where(skip, np.nan, y)
    pad = np.full(SIDE, np.nan)
    win = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, z, pad]), SIDE)
    segs = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(SIDE, -1), seg, np.full(SIDE, -1)]), SIDE)
    before = _row_median(np.where(segs[:n] == seg[:, None], win[:n], np.nan))
    after = _row_median(np.where(segs[SIDE + 1 : SIDE + 1 + n] == seg[:, None], win[SIDE + 1 : SIDE + 1 + n], np.nan))
    return before, after


def _season(y: np.ndarray, hour: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Median course over the hours of a day, from readings less their running daily level."""
    pad = np.full(12, np.nan)
    win = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, y, pad]), 25)
    segs = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(12, -1), seg, np.full(12, -1)]), 25)
    same = segs == seg[:, None]
    level = _row_median(np.where(same, win, np.nan))
    # a window cut short at a segment's end is lopsided within the day
    rest = np.where(same.sum(axis=1) >= 24, y - level, np.nan)
    out = np.zeros(24)
    for h in range(24):
        v = rest[hour == h]
        v = v[~np.isnan(v)]
        if len(v) >= 4:
            out[h] = np.median(v)
    return out[hour]


def scaled_residuals(y: np.ndarray, hour: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Signed residual over noise of each reading; nan where it can't be judged. y is nan where not to be used."""
    s = y - _season(y, hour, seg)
    skip = np.isnan(s)
    z = np.full(len(y), np.nan)
    for _ in range(3):
        b, a = _sides(s, seg, skip)
        db, da = s - b, s - a
        with np.errstate(invalid="ignore"):
            near = np.where(np.abs(db) < np.abs(da), db, da)
            r = np.where(np.sign(db) == np.sign(da), near, 0.0)
            r[np.isnan(db) | np.isnan(da)] = np.nan
            e = s - (b + a) / 2
            e = e[~np.isnan(e) & ~skip]
        if len(e) < 12:
            return z
        scale = 1.4826 * np.median(np.abs(e - np.median(e)))
        scale = max(scale, 1e-9 + 1e-4 * abs(float(np.median(y[~np.isnan(y)]))))
        z = r / scale
        new = skip | (np.abs(np.nan_to_num(z)) > 5.0)
        if (new == skip).all():
            break
        skip = new
    return z


def _stuck(x: np.ndarray, hours: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Readings in a run of STUCK_HOURS or more equal values an hour apart."""
    n = len(x)
    if not n:
        return np.zeros(0, bool)
    same = np.zeros(n, bool)
    same[1:] = usable[1:] & usable[:-1] & (x[1:] == x[:-1]) & (hours[1:] - hours[:-1] == 1)
    run = np.cumsum(~same)
    return usable & (np.bincount(run, minlength=run[-1] + 1)[run] >= STUCK_HOURS)


def judge_block(block: int, ids: np.ndarray, ts: np.ndarray, stopped: np.ndarray, values: dict[str, np.ndarray]) -> list[tuple]:
    """One source's block, in order of time: per channel its histogram, certain cases, and candidates with their neighbours' residuals."""
    _, once = np.unique(ids, return_index=True)
    if len(once) < len(ids):
        once.sort()
        ids, ts, stopped, values = ids[once], ts[once], stopped[once], {k: v[once] for k, v in values.items()}
    hours = ts // 3600
    own = (hours // BLOCK_HOURS) == block
    # a running segment ends at downtime and at holes of more than SIDE hours
    brk = np.zeros(len(ids), bool)
    brk[1:] = (stopped[1:] != stopped[:-1]) | (hours[1:] - hours[:-1] > SIDE)
    seg = np.cumsum(brk)
    hour = (hours % 24).astype(int)
    out = []
    for ch, (low, high) in PLAUSIBLE.items():
        x = values[ch]
        here = ~np.isnan(x) & (x != OUTAGE)
        with np.errstate(invalid="ignore"):
            impossible = here & ((x < low) | (x > high))
        z = scaled_residuals(np.where(here & ~impossible & ~stopped, x, np.nan), hour, seg)
        certain = own & (impossible | _stuck(x, hours, here & ~stopped))
        a = np.nan_to_num(np.abs(z))
        hist = np.bincount(np.minimum((a[own & ~np.isnan(z) & (a > 0)] / WIDTH).astype(int), BINS - 1), minlength=BINS)
        cand = np.flatnonzero(own & (a >= CANDIDATE))
        zz = np.concatenate([np.zeros(SPIKE_HOURS), np.nan_to_num(z), np.zeros(SPIKE_HOURS)])
        around = [zz[i : i + 2 * SPIKE_HOURS + 1].tolist() for i in cand]
        out.append((ch, hist.tolist(), ids[certain].tolist(), [{"id": int(ids[i]), "z": w} for i, w in zip(cand, around)]))
    return out


_JUDGED = "pump_id string, channel string, hist array<long>, certain array<long>, candidates array<struct<id:long,z:array<double>>>"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (pump_id, block, ts): one block at a time, whatever the batches."""
    names = ["pump_id", "channel", "hist", "certain", "candidates"]
    held: list[pd.DataFrame] = []
    at, rows = None, []

    def settle() -> None:
        p = pd.concat(held) if len(held) > 1 else held[0]
        args = (p[c].to_numpy() for c in ("reading_id", "ts", "stopped"))
        rows.extend((at[0], *x) for x in judge_block(int(at[1]), *args, {c: p[c].to_numpy(float) for c in PLAUSIBLE}))

    for pdf in batches:
        if not len(pdf):
            continue
        pump, block = pdf["pump_id"].to_numpy(), pdf["block"].to_numpy()
        cuts = np.flatnonzero((pump[1:] != pump[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
            if at != (pump[a], block[a]):
                if held:
                    settle()
                at, held = (pump[a], block[a]), []
            held.append(pdf.iloc[a:b])
        if len(rows) >= 1000:
            yield pd.DataFrame(rows, columns=names)
            rows = []
    if held:
        settle()
    if rows:
        yield pd.DataFrame(rows, columns=names)


def _judged(readings: DataFrame, periods: DataFrame) -> DataFrame:
    """A row a channel and block: histogram of scaled residuals, certain cases, candidates for spikes. Written once."""
    base = _values(readings)
    hour = F.floor(F.col("ts") / 3600)

    def blocks(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor((lo - HALO_HOURS) / BLOCK_HOURS), F.floor((hi + HALO_HOURS) / BLOCK_HOURS)))

    placed = base.filter("pump_id IS NOT NULL AND ts IS NOT NULL").withColumn("block", blocks(hour, hour))
    # disjoint periods of a block of hours: a bounded list
    down = periods.select("pump_id", "start_s", "end_s").withColumn("block", blocks(F.floor(F.col("start_s") / 3600), F.floor(F.col("end_s") / 3600)))
    down = down.groupBy("pump_id", "block").agg(F.collect_list(F.struct("start_s", "end_s")).alias("down"))
    stopped = F.coalesce(F.exists("down", lambda p: (p["start_s"] <= F.col("ts")) & (F.col("ts") < p["end_s"])), F.lit(False))
    # the join keeps this partitioning, so a block stays together; repeated rows fall out in the block
    judged = (
        placed.repartition(python_partitions(readings), "pump_id", "block")
        .join(down, ["pump_id", "block"], "left")
        .withColumn("stopped", stopped)
        .drop("down")
        .sortWithinPartitions("pump_id", "block", "ts", "reading_id")
        .mapInPandas(_judge, _JUDGED)
    )
    return materialized(judged, "judged")


def _values(readings: DataFrame) -> DataFrame:
    chans = [F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in PLAUSIBLE]
    return readings.select("reading_id", "pump_id", F.unix_seconds("timestamp").alias("ts"), *chans)


def _tails(judged: DataFrame, risk: float) -> DataFrame:
    """(channel, pump_id, n, threshold, scale, shape, faults, cut) of every source that has readings."""
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    zero = F.array_repeat(F.lit(0).cast("long"), BINS)
    # a histogram a block of hours: a short list
    by_source = judged.groupBy("channel", "pump_id").agg(F.aggregate(F.collect_list("hist"), zero, plus).alias("hist"))
    bins = judged.select("channel", F.posexplode("hist").alias("bin", "n")).groupBy("channel", "bin").agg(F.sum("n").alias("n"))
    # a row a channel
    pooled = bins.groupBy("channel").agg(F.sort_array(F.collect_list(F.struct("bin", "n")))["n"].alias("pooled"))

    @F.pandas_udf("threshold double, scale double, shape double, faults double, cut double")
    def fit(hist: pd.Series, pool: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([gpd_tail(np.asarray(h, float), np.asarray(p, float), risk) for h, p in zip(hist, pool)], columns=["threshold", "scale", "shape", "faults", "cut"])

    # else the optimizer runs it once more to filter on its result
    fit = fit.asNondeterministic()
    n = F.aggregate("hist", F.lit(0).cast("long"), lambda t, x: t + x).alias("n")
    # fitting is bound by CPU, not by size
    by_source = by_source.repartition(python_partitions(judged), "pump_id")
    return by_source.join(F.broadcast(pooled), "channel").select("channel", "pump_id", n, fit("hist", "pooled").alias("f")).select("channel", "pump_id", "n", "f.*")


def source_tails(readings: DataFrame, periods: DataFrame, risk: float = 1e-6) -> DataFrame:
    """(channel, pump_id, n, threshold, scale, shape, faults, cut): the fitted tail of every source and channel.

    n counts the residuals other than zero that the source adds of its own; where it is 0 (fewer than 12 readings to judge,
    all in downtime, or all alike) the tail is that of all sources and nothing of the source is judged by it.
    """
    return _tails(_judged(readings, periods), risk)


def implausible_readings(readings: DataFrame, periods: DataFrame, risk: float = 1e-6) -> DataFrame:
    """(reading_id, channel) of each impossible, stuck or spiking reading of a channel in PLAUSIBLE.

    readings: reading_id, pump_id, timestamp and the channels; periods: pump_id, start_s, end_s, disjoint
    downtimes in epoch seconds. Null and -999.0 are outages, never cases, and break runs of equal values.
    Repeated rows (same reading_id) count once. Rows with a null pump or timestamp have no course to be
    judged by: of them only impossible values come out. An empty table gives no rows.
    """
    judged = _judged(readings, periods)
    cut = _tails(judged, risk).select("channel", "pump_id", "cut")
    c = judged.filter(F.size("candidates") > 0).select("channel", "pump_id", F.inline("candidates")).join(cut, ["channel", "pump_id"])
    mid = F.col("z")[SPIKE_HOURS]
    # hours in a row on this side of the cutoff, around the candidate
    beyond = F.transform("z", lambda v: (F.abs(v) >= F.col("cut")) & (F.signum(v) == F.signum(mid)))

    def reach(step: int) -> Column:
        n, ok = F.lit(0), F.lit(True)
        for k in range(1, SPIKE_HOURS + 1):
            ok = ok & F.col("beyond")[SPIKE_HOURS + step * k]
            n = n + ok.cast("int")
        return n

    spikes = (
        c.filter(F.abs(mid) >= F.col("cut"))
        .withColumn("beyond", beyond)
        .filter(reach(-1) + reach(1) + 1 <= SPIKE_HOURS)
        .select(F.col("id").alias("reading_id"), "channel")
    )
    certain = judged.select(F.explode("certain").alias("reading_id"), "channel")
    lost = _values(readings).filter("pump_id IS NULL OR ts IS NULL")
    odd = F.array(
        *[
            F.when((F.col(ch) != OUTAGE) & ((F.col(ch) < lo) | (F.col(ch) > hi)), F.lit(ch))
            for ch, (lo, hi) in PLAUSIBLE.items()
        ]
    )
    nowhere = lost.select("reading_id", F.explode(F.filter(odd, lambda x: x.isNotNull())).alias("channel"))
    return spikes.unionByName(certain).unionByName(nowhere).distinct()
