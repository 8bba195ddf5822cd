"""Time stamps in mixed formats and clocks, brought to one UTC instant.

A stamp that carries no zone may be read with the day or the month first, on universal time or on its
site's clock. Every source is a mixture of these readings. A reading is the likelier, the better its
instant agrees with when the line arrived. How long lines take to arrive is learned from the stamps whose
instant the line itself tells (an offset, a zone, an epoch number), over all sources.
Expectation-maximisation finds each source's mixture. Then the sources whose mixture is clear teach the wording
of notes (``wording``), and the wording is the prior of every mixture in a second run. The posterior picks
each stamp's reading, and a stamp whose two best readings differ and are about equally likely is marked unresolved.

EM needs, of each source, only how many stamps show which pattern of lag classes. These counts
are combined before the shuffle, and there are at most (classes ** readings) of them a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.operators.wording import runs_of_words, wording_prior
from shoal.session import materialized, python_partitions

READINGS = [("day", "utc"), ("day", "site"), ("month", "utc"), ("month", "site")]
#: Upper ends, in seconds, of the classes of lag from stamp to arrival: before the stamp, then finer near it.
LAGS = [-60, 0, *[60 * 2**k / 2 for k in range(1, 16)], 400 * 86_400]
#: Lag class of a reading that is no date; of one whose site's clock or whose arrival isn't known.
NEVER, UNKNOWN = 0, 1
EM_STEPS = 30
#: Imagined stamps that spread over the readings: evenly in the first run; by the wording of the notes in the second, the more the surer it is.
IMAGINED, WORDED = 4.0, 20.0

# fixed values: minutes east of UTC of the zone abbreviations programs print
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "NST": -210, "NDT": -150, "JST": 540, "AEST": 600, "AEDT": 660,
}


def zone_minutes(zone: Column) -> Column:
    """Minutes east of UTC of an offset or abbreviation; null if there is none or it is unknown."""
    m = r"^(?:UTC)?([+-])(\d\d):?(\d\d)$"
    sign = F.when(F.regexp_extract(zone, m, 1) == "-", -1).otherwise(1)
    offset = sign * (F.regexp_extract(zone, m, 2).cast("int") * 60 + F.regexp_extract(zone, m, 3).cast("int"))
    names = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    return F.when(zone.rlike(m), offset).otherwise(F.element_at(names, zone))


# fixed values: where each kind of stamp holds (year, month or first number, day or second number, hour, minute, second): (first character, length)
PLACES = {
    "iso": ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2)),
    "plain": ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2)),
    "dmon": ((8, 4), (4, 3), (1, 2), (13, 2), (16, 2), (19, 2)),
    "14": ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2)),
    "packed": ((1, 2), (3, 2), (5, 2), (7, 2), (9, 2), None),
    "slash24": ((7, 4), (4, 2), (1, 2), (12, 2), (15, 2), None),
    "slash12": ((7, 2), (4, 2), (1, 2), (10, 2), (13, 2), None),
}
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def stamp_parts(kind: Column, stamp: Column) -> dict[str, Column]:
    """Numbers of a stamp: y, m, d (slash dates read with the day first), h, n, s, and ms within the second; null where they are no numbers."""
    out = {}
    for i, name in enumerate("ymdhns"):
        c = F.lit(None).cast("int")
        for k, places in PLACES.items():
            at = places[i]
            part = F.lit(0) if at is None else F.substring(stamp, *at)
            if k == "dmon" and name == "m":
                where = F.instr(F.lit(MONTHS), part)
                part = F.when(where % 3 == 1, ((where + 2) / 3).cast("int"))
            elif at is not None:
                part = part.try_cast("int")
            if name == "y" and at[1] == 2:
                part = part + 2000
            if k == "slash12" and name == "h":
                # 12 o'clock is the first hour of either half
                part = F.when((part >= 1) & (part <= 12), part % 12 + F.when(F.substring(stamp, 15, 1) == "P", 12).otherwise(0))
            c = F.when(kind == k, part).otherwise(c)
        out[name] = c
    dot = F.instr(stamp, ".")
    out["ms"] = F.when((kind == "iso") & (dot > 0), F.rpad(F.substring(stamp, 21, 3), 3, "0").try_cast("int")).otherwise(0)
    return out


def _instant(y: Column, m: Column, d: Column) -> Column:
    """The wall-clock reading as if it were UTC, in milliseconds; null where it is no date."""
    return F.unix_millis(F.try_make_timestamp(y, m, d, F.col("h"), F.col("n"), F.col("s"), F.lit("UTC"))) + F.col("ms")


# fixed values: words that notes say such things with, to begin with
CLOCK_WORDS = {"utc": ["utc", "zulu", "universal time"], "site": ["local time", "wall clock", "site time"]}
ORDER_WORDS = {"day": ["day before", "with the day", "dd/mm"], "month": ["month before", "with the month", "mm/dd"]}


def _lag_class(ms: Column, arrived: Column, place_known: Column) -> Column:
    """Class of the lag: NEVER, UNKNOWN, or 2 + the place in LAGS."""
    lag = (arrived - ms) / 1000
    doubled = F.least(F.floor(F.log2(lag / 60)), F.lit(len(LAGS) - 4)).cast("int") + 5
    c = F.when(lag < LAGS[0], 2).when(lag < 0, 3).when(lag < 60, 4).when(lag < LAGS[-1], doubled).otherwise(len(LAGS) + 2)
    return F.when(~place_known, UNKNOWN).when(ms.isNull(), NEVER).when(arrived.isNull(), UNKNOWN).otherwise(c)


def stamp_readings(entries: DataFrame, streams: DataFrame, sites: DataFrame) -> DataFrame:
    """entries (line_id, stream, site, stamp_kind, stamp, zone, arrived) with every reading's instant.

    Adds ``fixed`` (the instant where the line itself tells it) and its lag class ``told``, the arrays ``at`` and ``cls``
    (instant and lag class of each of READINGS), and the stream's ``notes``. at is null where a reading is no date or
    its site isn't listed. Stamps other than slash dates have the same instant under either order.
    """
    # one row a key, so that repeated rows can't multiply stamps
    place = sites.groupBy("site").agg(F.max(F.struct("utc_offset_min", "tz_name")).alias("z")).select("site", "z.*")
    notes = streams.groupBy("stream").agg(F.max_by("notes", F.coalesce(F.length("notes"), F.lit(-1))).alias("notes"))
    kind, stamp = F.col("stamp_kind"), F.col("stamp")
    e = entries.select("line_id", "stream", "site", "stamp_kind", "stamp", "zone", "arrived")
    # sites is a fixed table of a few dozen rows; its size is checked by the optimizer like any other
    e = e.join(place, "site", "left").join(notes, "stream", "left")
    digits = F.length(stamp)
    epoch = F.when(kind == "epoch", stamp.try_cast("long"))
    epoch = F.when(digits <= 11, epoch * 1000).when(digits <= 14, epoch).otherwise(F.floor(epoch / 1000))
    slashed = kind.isin("slash24", "slash12")
    e = e.select("*", *[c.alias(k) for k, c in stamp_parts(kind, stamp).items()])
    e = e.withColumn("day", _instant(F.col("y"), F.col("m"), F.col("d")))
    e = e.withColumn("month", F.when(slashed, _instant(F.col("y"), F.col("d"), F.col("m"))).otherwise(F.col("day")))
    offset = zone_minutes(F.col("zone"))
    zoned = F.when(F.col("zone").isNotNull(), F.col("day") - offset * 60_000)

    def on_site(ms: Column) -> Column:
        # to_utc_timestamp takes the first of two instants where the clock is set back
        moved = F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(ms), F.coalesce("tz_name", F.lit("UTC"))))
        return F.when(F.col("tz_name").isNotNull(), moved).otherwise(ms - F.col("utc_offset_min") * 60_000)

    told = kind.eqNullSafe("epoch") | F.col("zone").isNotNull()
    arrived = F.unix_millis("arrived")
    placed = F.coalesce(F.col("tz_name"), F.col("utc_offset_min").cast("string")).isNotNull()
    e = e.withColumn("site_day", on_site(F.col("day")))
    e = e.withColumn("site_month", F.when(slashed, on_site(F.col("month"))).otherwise(F.col("site_day")))
    at = [F.col(order if clock == "utc" else f"site_{order}") for order, clock in READINGS]
    e = e.withColumn("fixed", F.coalesce(epoch, zoned)).withColumn("at", F.when(~told, F.array(*at)))
    cls = [
        _lag_class(F.col("at")[i], arrived, placed | F.lit(clock == "utc") | F.col(order).isNull()) for i, (order, clock) in enumerate(READINGS)
    ]
    e = e.withColumn("cls", F.when(~told, F.array(*cls)))
    e = e.withColumn("told", F.when(F.col("fixed").isNotNull() & arrived.isNotNull(), _lag_class(F.col("fixed"), arrived, F.lit(True))))
    return e.select("line_id", "stream", "notes", "fixed", "told", "at", "cls")


def lag_likelihood(read: DataFrame) -> DataFrame:
    """One row, ``like``: the likelihood, a second, of every lag class, learned from the told stamps of all sources.

    One imagined stamp a class stands in where few are told: classes widen with the lag, so that makes short lags the
    likelier. NEVER and UNKNOWN are 0 here; the latter is as likely as the likeliest known reading of its stamp.
    """
    widths = [400 * 86_400.0, 60.0] + [b - max(a, 0) for a, b in zip(LAGS[1:], LAGS[2:])] + [400 * 86_400.0]
    counts = read.agg(*[F.count(F.when(F.col("told") == i + 2, 1)).alias(f"n{i}") for i in range(len(widths))])
    n = [F.col(f"n{i}") + 1.0 for i in range(len(widths))]
    total = sum(n[1:], n[0])
    dens = [x / total / w for x, w in zip(n, widths)]
    return counts.select(F.array(F.lit(0.0), F.lit(0.0), *dens).alias("like"))


def _em(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """EM over every source's patterns of lag classes, all sources of a batch at once: the weight of each reading."""
    for pdf in batches:
        if not len(pdf):
            continue
        sizes = pdf["patterns"].map(len).to_numpy()
        src = np.repeat(np.arange(len(pdf)), sizes)
        flat = [p for ps in pdf["patterns"] for p in ps]
        cls = np.array([p["cls"] for p in flat], int).reshape(len(flat), len(READINGS))
        n = np.array([p["n"] for p in flat], float)
        like = np.take_along_axis(np.array(pdf["like"].tolist(), float)[src], cls, axis=1)
        # an unknown clock speaks neither for nor against its reading
        most = np.where(cls == UNKNOWN, 0.0, like).max(axis=1, initial=0.0, keepdims=True)
        like = np.where(cls == UNKNOWN, np.where(most > 0, most, 1.0), like)
        prior = np.array(pdf["prior"].tolist(), float)
        w = prior / prior.sum(axis=1, keepdims=True)
        for _ in range(EM_STEPS):
            post = like * w[src]
            total = post.sum(axis=1, keepdims=True)
            post = np.divide(post, total, out=np.zeros_like(post), where=total > 0) * n[:, None]
            w = prior.copy()
            for k in range(len(READINGS)):
                w[:, k] += np.bincount(src, weights=post[:, k], minlength=len(pdf))
            w /= w.sum(axis=1, keepdims=True)
        yield pdf[["stream", "like"]].assign(weights=list(w))[["stream", "weights", "like"]]


_MIXED = "stream string, weights array<double>, like array<double>"


def source_mixtures(read: DataFrame, clear: float = 0.9) -> DataFrame:
    """(stream, weights, like): the mixture of READINGS of every source that has stamps without a zone.

    like is the likelihood of each lag class. A source whose mixture gives a clock (an order of day and month) ``clear`` or more
    teaches the wording of its notes.
    """
    counts = read.filter(F.col("cls").isNotNull()).groupBy("stream", "cls").agg(F.count("*").alias("n"), F.first("notes").alias("notes"))
    # patterns, not stamps: a bounded list
    by = counts.groupBy("stream").agg(F.first("notes").alias("notes"), F.collect_list(F.struct("cls", "n")).alias("patterns"))
    # one row
    by = materialized(by.crossJoin(F.broadcast(lag_likelihood(read))), "patterns")
    tasks = python_partitions(read)
    flat = F.array(*[F.lit(IMAGINED / len(READINGS))] * len(READINGS))
    first = by.withColumn("prior", flat).drop("notes").repartition(tasks, "stream").mapInPandas(_em, _MIXED)
    first = materialized(first.select("stream", "weights"), "mixtures")
    said = by.select("stream", "notes")
    grams = runs_of_words(said, "stream", "notes")
    prior = said.select("stream")
    for name, place, labels, seeds in (("order", 0, ["day", "month"], ORDER_WORDS), ("clock", 1, ["utc", "site"], CLOCK_WORDS)):
        share = {x: sum((F.col("weights")[i] for i, r in enumerate(READINGS) if r[place] == x), F.lit(0.0)) for x in labels}
        known = first.select("stream", F.coalesce(*[F.when(share[x] >= clear, x) for x in labels]).alias("label"))
        prior = prior.join(wording_prior(said, "stream", "notes", known, labels, seeds, grams).withColumnRenamed("prior", name), "stream")
    joint = [F.col("order")[["day", "month"].index(o)] * F.col("clock")[["utc", "site"].index(c)] for o, c in READINGS]
    even = 1 / len(READINGS)
    worth = IMAGINED + (WORDED - IMAGINED) * (F.greatest(*joint) - even) / (1 - even)
    joint = F.array(*[worth * x for x in joint])
    second = by.drop("notes").join(prior.select("stream", joint.alias("prior")), "stream")
    return second.repartition(tasks, "stream").mapInPandas(_em, _MIXED)


def resolve_stamps(read: DataFrame, mixtures: DataFrame, odds: float = 20.0) -> DataFrame:
    """(line_id, utc_ms, posterior, unresolved) of every stamp that has a possible reading.

    utc_ms is null and unresolved true where no reading's instant is ``odds`` times as likely as the next
    other instant. Stamps that are no date, or whose site's clock is needed and unknown, don't come out.
    """
    n = range(len(READINGS))
    # mixtures has one row a source
    j = read.join(mixtures, "stream", "left").select(
        "line_id", "fixed",
        *[F.col("at")[k].cast("double").alias(f"a{k}") for k in n],
        *[F.when(F.col("cls")[k] == UNKNOWN, -1.0).otherwise(F.element_at("like", F.col("cls")[k] + 1)).alias(f"l{k}") for k in n],
        *[F.col("weights")[k].alias(f"w{k}") for k in n],
    )

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, like, w = (pdf[[f"{c}{k}" for k in n]].to_numpy(float) for c in "alw")
            most = like.max(axis=1, initial=0.0, keepdims=True, where=like >= 0)
            # an unknown clock is as likely as the likeliest known reading; NEVER counts for nothing
            s = np.nan_to_num(np.where(like < 0, np.where(most > 0, most, 1.0), like) * w)
            # readings of one instant count together; those on an unknown clock are one option, without an instant
            mark = np.where(np.isnan(at), -np.inf, at)
            t = np.stack([np.where(mark == mark[:, [k]], s, 0.0).sum(axis=1) for k in n], axis=1)
            t = np.where(s > 0, t, 0.0)
            best = np.lexsort((-mark, -t))[:, 0] if len(pdf) else np.zeros(0, int)
            rows = np.arange(len(pdf))
            first, top = mark[rows, best], t[rows, best]
            second = np.where(mark == first[:, None], 0.0, t).max(axis=1, initial=0.0)
            told = pdf["fixed"].notna().to_numpy()
            clear = (top > 0) & (top >= second * odds)
            out = pd.DataFrame({"line_id": pdf["line_id"]})
            found = pd.Series(np.where(clear & np.isfinite(first), first, np.nan), out.index)
            out["utc_ms"] = pdf["fixed"].astype("Int64").where(told, found.round().astype("Int64"))
            out["posterior"] = np.where(told, 1.0, top / np.maximum(s.sum(axis=1), 1e-300))
            out["unresolved"] = ~told & (top > 0) & ~clear
            yield out[out["utc_ms"].notna() | out["unresolved"]]

    return j.mapInPandas(pick, f"line_id {read.schema['line_id'].dataType.simpleString()}, utc_ms long, posterior double, unresolved boolean")
