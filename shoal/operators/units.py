"""Quantities recorded in different units: find each source's units, convert to common ones.

Units are chosen per source so that physical identities hold with the smallest log residual (``solve_units``).
An identity is a product among columns: mass = density * volume among the columns of a row, or, between two
columns that are never met on one row, that they measure the same thing of the same plant, so that their mean
logarithms agree. A log reading printed without its unit is bound so to the readings of its stream that
carry one (``reading_units``).

Where another choice of units of different size fits about as well, the choice is not unique. Only then are a
stream's notes asked, by wording learned from the streams whose units the identities decide (``wording``); what
they leave open too stays open. All evidence is sums and counts by source, combined before the shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.operators.wording import runs_of_words, wording_prior
from shoal.session import materialized

# fixed values: (offset added first, factor) to tenths of a degree Celsius or of a kilopascal; 1 psi = 6.894757 kPa
CONVERSIONS = {
    "temp": {"C": ("0", "10"), "F": ("-32", "50/9"), "K": ("-273.15", "10"), "tenths": ("0", "1"), "hundredths": ("0", "1/10")},
    "pres": {
        "kPa": ("0", "10"),
        "MPa": ("0", "10000"),
        "hPa": ("0", "1"),
        "bar": ("0", "1000"),
        "psi": ("0", "68.94757"),
        "tenths": ("0", "1"),
        "hundredths": ("0", "1/10"),
    },
}
# fixed values: names of the units in print and in notes
UNIT_NAMES = {
    "temp": {
        "C": ["c", "°c", "degc", "celsius", "degrees c", "centigrade"],
        "F": ["f", "°f", "degf", "fahrenheit", "degrees f"],
        "K": ["k", "kelvin"],
    },
    "pres": {
        "kPa": ["kpa", "kilopascal"],
        "MPa": ["mpa", "megapascal"],
        "hPa": ["hpa", "mbar", "hectopascal", "millibar"],
        "bar": ["bar"],
        "psi": ["psi", "lbf/in2", "pounds per square inch"],
    },
}
CLASSES = {"bare": {"temp": ["C", "F", "K"], "pres": ["kPa", "MPa", "hPa", "bar", "psi"]}, "packed": {q: ["tenths", "hundredths"] for q in ("temp", "pres")}}
#: Scatter of mean logarithms between two measurements of the same thing, beyond their standard errors.
SCATTER = 0.02
#: Log-likelihood by which the best units must beat the next of other size to be unique.
UNIQUE = 8.0
#: The same where the notes' wording is counted in.
TOLD = 2.0
# fixed values: words that scales of point-less numbers go by
SCALE_NAMES = {"tenths": ["tenths"], "hundredths": ["hundredths"]}


def unit_of(name: Column, quantity: str) -> Column:
    """The unit that a printed or spelled-out name stands for; null for any other."""
    pairs = [F.lit(x) for unit, names in UNIT_NAMES[quantity].items() for n in names for x in (n, unit)]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(name)))


def to_tenths(raw: Column, unit: Column, quantity: str) -> Column:
    """The reading in tenths of the common unit, exact decimals rounded half away from zero."""
    x = F.expr("NULL").cast("decimal(38,12)")
    value = raw.try_cast("decimal(18,6)")
    for u, (offset, factor) in CONVERSIONS[quantity].items():
        num, _, den = factor.partition("/")
        y = (value + F.lit(offset).cast("decimal(8,3)")) * F.lit(num).cast("decimal(12,5)")
        x = F.coalesce(x, F.when(unit == u, (y / F.lit(int(den)).cast("decimal(4,0)") if den else y).cast("decimal(38,12)")))
    return F.round(x, 0).cast("long")


def readings(entries: DataFrame) -> DataFrame:
    """(line_id, stream, quantity, class, raw, unit): one row a reading; class printed, bare or packed."""
    parts = []
    for q in ("temp", "pres"):
        unit = F.col(f"{q}_unit")
        parts.append(
            F.struct(
                F.lit(q).alias("quantity"),
                F.when(unit.isNull(), "bare").when(unit == "packed", "packed").otherwise("printed").alias("class"),
                F.col(f"{q}_raw").alias("raw"),
                unit_of(unit, q).alias("unit"),
            )
        )
    return entries.select("line_id", "stream", F.inline(F.array(*parts))).filter(F.col("raw").isNotNull())


def _log_size(raw: Column, unit: Column, quantity: str) -> Column:
    """Logarithm of the absolute quantity (kelvin, kilopascal); null where it can't be."""
    tenths = to_tenths(raw, unit, quantity).cast("double")
    return F.ln(F.when(tenths / 10 + (273.15 if quantity == "temp" else 0) > 0, tenths / 10 + (273.15 if quantity == "temp" else 0)))


def reading_units(read: DataFrame, streams: DataFrame) -> DataFrame:
    """(stream, quantity, class, unit, residual, unique) for readings without a printed unit.

    residual is how far the mean logarithm of the converted readings lies from that of the stream's
    readings with a unit (of all streams' where it has none). unique tells that the identity alone decides; where it
    doesn't, the notes may, and unit is null where they don't either. Temperature and pressure of point-less numbers
    share their scale.
    """
    q, c = F.col("quantity"), F.col("class")
    of = {f"{k}_{qq}": (k, qq) for k, by in CLASSES.items() for qq in by}
    cols = {name: F.when((q == qq) & (c == k), F.col("raw")) for name, (k, qq) in of.items()}
    printed = {f"printed_{qq}": F.when((q == qq) & (c == "printed"), _log_size(F.col("raw"), F.col("unit"), qq)) for qq in ("temp", "pres")}
    wide = read.select("stream", *[x.alias(n) for n, x in {**cols, **printed}.items()])
    units: dict = {n: {u: (lambda x, u=u, qq=qq: _log_size(x, F.lit(u), qq)) for u in CLASSES[k][qq]} for n, (k, qq) in of.items()}
    # already logarithms of common units
    units |= {n: {"common": lambda x: x} for n in printed}
    same = [{n: 1, f"printed_{qq}": -1} for n, (_, qq) in of.items()]
    solved = solve_units(wide, "stream", units, same, paired=False, linked=[("packed_temp", "packed_pres")], scores=True)
    solved = materialized(solved, "solved")
    notes = streams.groupBy("stream").agg(F.max_by("notes", F.coalesce(F.length("notes"), F.lit(-1))).alias("notes"))
    # what follows the name of a scale speaks of point-less numbers
    bare = notes.withColumn("notes", F.regexp_replace("notes", r"(?i)\b(?:tenths|hundredths)\b[^.]*", ""))
    bare_grams, all_grams = runs_of_words(bare, "stream", "notes"), runs_of_words(notes, "stream", "notes")
    out = None
    for group, names, seeds in (
        (["bare_temp"], CLASSES["bare"]["temp"], UNIT_NAMES["temp"]),
        (["bare_pres"], CLASSES["bare"]["pres"], UNIT_NAMES["pres"]),
        (["packed_temp", "packed_pres"], CLASSES["packed"]["temp"], SCALE_NAMES),
    ):
        first = group[0]
        known = solved.select("stream", F.col(f"{first}_unit").alias("label"))
        prior = wording_prior(notes, "stream", "notes", known, names, seeds, all_grams if seeds is SCALE_NAMES else bare_grams)
        scored = solved.join(prior, "stream", "left")
        # the log-likelihood of each unit with the notes counted in
        both = F.array_sort(
            F.transform(
                f"{first}_scores",
                lambda x: F.struct((x["score"] - F.ln(F.coalesce(F.element_at("prior", x["at"]), F.lit(1.0 / len(names))))).alias("score"), x["unit"].alias("unit"), x["residual"].alias("residual")),
            )
        )
        best, nxt = F.try_element_at("both", F.lit(1)), F.try_element_at("both", F.lit(2))
        told = best.isNotNull() & (nxt.isNull() | (nxt["score"] - best["score"] > TOLD))
        scored = scored.withColumn("both", both)
        for n in group:
            k, qq = of[n]
            part = scored.filter(F.col(f"{n}_n") > 0).select(
                "stream", F.lit(qq).alias("quantity"), F.lit(k).alias("class"), F.coalesce(f"{first}_unit", F.when(told, best["unit"])).alias("unit"),
                F.coalesce(F.col(f"{first}_residual"), best["residual"]).alias("residual"), F.coalesce(f"{first}_unique", F.lit(False)).alias("unique"),
            )
            out = part if out is None else out.unionByName(part)
    return out


def common_units(read: DataFrame, units: DataFrame) -> DataFrame:
    """(line_id, quantity, value_tenths) of every reading whose unit is printed or was found."""
    told = units.filter(F.col("unit").isNotNull()).select("stream", "quantity", "class", F.col("unit").alias("found"))
    full = read.join(told, ["stream", "quantity", "class"], "left").withColumn("u", F.coalesce("unit", "found"))
    value = F.when(F.col("quantity") == "temp", to_tenths(F.col("raw"), F.col("u"), "temp")).otherwise(to_tenths(F.col("raw"), F.col("u"), "pres"))
    return full.select("line_id", "quantity", value.alias("value_tenths")).filter(F.col("value_tenths").isNotNull())


def _components(units: Mapping[str, Mapping], identities: Sequence[Mapping[str, int]], linked: Sequence[Sequence[str]]) -> list[list[str]]:
    """Columns with a choice of units, grouped by the identities and links that bind them."""
    group = {c: {c} for c in units if len(units[c]) > 1}
    for bound in [list(i) for i in identities] + [list(x) for x in linked]:
        bound = [c for c in bound if c in group]
        whole = set().union(*[group[c] for c in bound]) if bound else set()
        for c in whole:
            group[c] = whole
    return [[c for c in units if c in g] for g in {id(g): g for g in group.values()}.values()]


def solve_units(
    df: DataFrame,
    source: str,
    units: Mapping[str, Mapping[str, float | Callable[[Column], Column]]],
    identities: Sequence[Mapping[str, int]],
    tolerance: float = 0.05,
    paired: bool = True,
    linked: Sequence[Sequence[str]] = (),
    scores: bool = False,
) -> DataFrame:
    """Units of each source's columns from product identities among them.

    units: column -> {unit: factor to the common unit, or a function from the column to the logarithm of the value in
    common units}; identities: each {column: exponent}, the product of column ** exponent being 1 in common units (mass =
    density * volume is {"mass": 1, "density": -1, "volume": -1}). Comes out: source, one unit column for each
    (``<column>_unit``), residual (root of summed squared mean log residuals) and unique (false where another combination of other
    size is within ``tolerance``; the units are then null). Rows with null, zero or negative values in an
    identity's columns don't count in it; a source without any such row has no unique solution.

    paired = False is for columns that are never met on one row: an identity then binds their means, each over its
    own rows, and combinations are weighed by the squared residual over its variance, uniqueness being a log-likelihood of UNIQUE.
    Columns with a single unit that a source lacks are taken from all sources. linked names columns that share their unit.
    Sets of columns that no identity binds are solved apart: comes out, for each column, its unit, ``_residual``, ``_unique``,
    ``_n`` (its readings) and with scores = True ``_scores`` (score, place of the unit from 1, unit, residual of every choice).
    """
    cols = list(units)

    def log_of(c: str, u: str) -> Column:
        how = units[c][u]
        return how(F.col(c)) if callable(how) else F.ln(F.when(F.col(c).cast("double") > 0, F.col(c).cast("double") * F.lit(float(how))))

    if paired:
        # the mean of a sum of logarithms is the sum of means over the rows that hold all
        aggs = []
        for k, ident in enumerate(identities):
            whole = F.lit(True)
            for c in ident:
                whole = whole & log_of(c, next(iter(units[c]))).isNotNull()
            aggs += [F.avg(F.when(whole, log_of(c, u))).alias(f"m{k}_{cols.index(c)}_{i}") for c in ident for i, u in enumerate(units[c])]
        stats = df.groupBy(source).agg(*aggs)
        rows = []
        for combo in itertools.product(*[list(enumerate(units[c])) for c in cols]):
            at = dict(zip(cols, combo))
            ss = F.lit(0.0)
            for k, ident in enumerate(identities):
                r = F.lit(0.0)
                for c, e in ident.items():
                    r = r + float(e) * F.col(f"m{k}_{cols.index(c)}_{at[c][0]}")
                ss = ss + r * r
            rows.append(F.struct(F.sqrt(ss).alias("residual"), *[F.lit(at[c][1]).alias(f"{c}_unit") for c in cols]))
        ordered = stats.select(source, F.array_sort(F.filter(F.array(*rows), lambda x: x["residual"].isNotNull())).alias("c"))
        best, second = F.try_element_at("c", F.lit(1)), F.try_element_at("c", F.lit(2))
        unique = F.coalesce(best["residual"].isNotNull() & (second["residual"].isNull() | (second["residual"] - best["residual"] > tolerance)), F.lit(False))
        return ordered.select(
            source, *[F.when(unique, best[f"{c}_unit"]).alias(f"{c}_unit") for c in cols], best["residual"].alias("residual"), unique.alias("unique")
        )

    def sums(c: str, how: str) -> list[Column]:
        return [f(log_of(c, u)).alias(f"{how}{cols.index(c)}_{i}") for i, u in enumerate(units[c]) for f in [{"m": F.avg, "v": F.var_pop, "n": F.count}[how]]]

    fixed = [c for c in cols if len(units[c]) == 1]
    stats = df.groupBy(source).agg(*[x for c in cols for how in "mvn" for x in sums(c, how)])
    # one row
    overall = df.agg(*[x.alias(f"all_{how}{cols.index(c)}") for c in fixed for how in "mvn" for x in sums(c, how)])
    stats = stats.crossJoin(F.broadcast(overall))

    def stat(c: str, i: int, how: str) -> Column:
        own = F.col(f"{how}{cols.index(c)}_{i}")
        if c not in fixed:
            return own
        return F.when(F.col(f"n{cols.index(c)}_0") > 0, own).otherwise(F.col(f"all_{how}{cols.index(c)}"))

    def spread(c: str) -> Column:
        """Variance of a reading's logarithm: of all sources' known readings where the column has any bound to it, else its own."""
        return F.col(f"all_v{cols.index(c)}")

    picked = []
    for group in _components(units, identities, linked):
        bound = [i for i in identities if any(c in group for c in i)]
        choices = []
        for combo in itertools.product(*[list(enumerate(units[c])) for c in group]):
            at = dict(zip(group, combo))
            if any(len({at[c][1] for c in link if c in at}) > 1 for link in linked):
                continue
            score, ss = F.lit(0.0), F.lit(0.0)
            any_ = F.lit(False)
            for ident in bound:
                known = [c for c in ident if c in fixed]
                var = F.coalesce(*[spread(c) for c in known], F.lit(1.0)) if known else F.lit(1.0)
                var = F.greatest(var, F.lit(1e-6))
                r, err, there = F.lit(0.0), F.lit(SCATTER**2), F.lit(True)
                for c, e in ident.items():
                    i = at[c][0] if c in at else 0
                    r = r + float(e) * stat(c, i, "m")
                    err = err + float(e * e) * var / stat(c, i, "n")
                    there = there & (stat(c, i, "n") > 0)
                score = score + F.when(there, r * r / err / 2).otherwise(0.0)
                ss = ss + F.when(there, r * r).otherwise(0.0)
                any_ = any_ | there
            # a unit under which readings have no logarithm explains fewer of them
            for c in group:
                most = F.greatest(*[F.col(f"n{cols.index(c)}_{i}") for i in range(len(units[c]))])
                score = score + UNIQUE * (most - F.col(f"n{cols.index(c)}_{at[c][0]}"))
            names = [at[c][1] for c in group]
            place = list(units[group[0]]).index(names[0]) + 1
            choices.append(F.struct(score.alias("score"), F.lit(place).alias("at"), F.lit(names[0]).alias("unit"), F.when(any_, F.sqrt(ss)).alias("residual"), *[F.lit(x).alias(f"u{k}") for k, x in enumerate(names)]))
        picked.append((group, F.array_sort(F.array(*choices))))
    out = stats.select(source, *[F.greatest(*[F.col(f"n{cols.index(c)}_{i}") for i in range(len(units[c]))]).alias(f"{c}_n") if len(units[c]) > 1 else F.col(f"n{cols.index(c)}_0").alias(f"{c}_n") for c in cols], *[x.alias(f"{g[0]}_c") for g, x in picked])
    res = [source, *[f"{c}_n" for c in cols]]
    for group, _ in picked:
        arr = F.col(f"{group[0]}_c")
        first, second = arr[0], F.try_element_at(arr, F.lit(2))
        unique = first["residual"].isNotNull() & (second.isNull() | (second["score"] - first["score"] > UNIQUE))
        for k, c in enumerate(group):
            res += [F.when(unique, first[f"u{k}"]).alias(f"{c}_unit"), first["residual"].alias(f"{c}_residual"), unique.alias(f"{c}_unique")]
            if scores:
                res.append(arr.alias(f"{c}_scores"))
    return out.select(*res)
