"""Six fixed log-line layouts to one canonical record, with the rules learned from labelled pairs.

All patterns are anchored and strict: a damaged line fits none and becomes REJECT. Parsing is regular-expression
and date expressions only, in generated code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed formats of the programs: a line as it is printed, with {field:form} where a value stands; F3 is apart
PRINTED = {
    "F1": "{time:dashed} | {type}-{number} @ {site} | T={temp}F P={pres}psi | {status:word}",
    "F2": "<{type:letter}{number}|{site}|{time:digits14}|t:{temp:tenths}|p:{pres:tenths}|s:{status:digit}>",
    "F4": "{type:letter}{number}{site:padded}{time:digits10}{temp:signed4}{pres:digits6}{status:letter}",
    "F5": "{site},{type}-{number},{time:ampm},{temp},{pres},{status:three}",
    "F6": '{"st":"{site}","d":"{type}-{number}","e":{time:epoch},"tc":{temp:tenths},"pk":{pres:tenths},"x":"{status:small}"}',
}
#: What a form looks like; a field without a form is in its own.
FORMS = {
    "type": "[A-Z]{3}", "letter": "[A-Z]", "number": "[0-9]{4}", "site": "[A-Z]{2,4}[0-9]?", "temp": "-?[0-9]+[.][0-9]+", "pres": "-?[0-9]+[.][0-9]+", "tenths": "-?[0-9]+[.][0-9]",
    "signed4": "[+-][0-9]{4}", "digits6": "[0-9]{6}", "digits10": "[0-9]{10}", "digits14": "[0-9]{14}", "epoch": "[0-9]+", "digit": "[0-9]", "word": "[A-Z]+", "three": "[A-Z]{3}", "small": "[a-z]+",
    "dashed": "[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", "ampm": "[0-9]{2}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}[AP]M",
}


def _compiled(printed: str) -> tuple[str, list[str]]:
    """(anchored pattern, field of each group) of a line as it is printed."""
    out, fields, at = "^", [], 0
    for m in re.finditer(r"\{(\w+)(?::(\w+))?\}", printed):
        out += re.sub(r"([^\w\s<>,:@=-])", r"\\\1", printed[at : m.start()])
        form = m[2] or m[1]
        # a padded site fills its place with blanks after it
        out += f"({FORMS['site']}) *" if form == "padded" else f"({FORMS[form]})"
        fields.append(m[1])
        at = m.end()
    return out + re.sub(r"([^\w\s<>,:@=-])", r"\\\1", printed[at:]) + "$", fields


LAYOUTS = {name: _compiled(printed) for name, printed in PRINTED.items()}
# F3 is six key=value pairs in any order
F3_KEYS = ["dev", "site", "time", "temp", "pressure", "flag"]
# fixed values: ways to print a number, as (added first, factor) to the canonical unit; 1 psi = 6.894757 kPa
CONVERSIONS = {"as printed": (0.0, 1.0), "in tenths": (0.0, 0.1), "fahrenheit": (-32.0, 5 / 9), "psi": (0.0, 6.894757)}
FIELDS = ["ts", "dev", "site", "temp_c", "pres_kpa", "status"]


@dataclass
class Rules:
    """What is learned from pairs: numeric transforms by layout and field, vocabularies, date orders, local or UTC."""

    numbers: dict[tuple[str, str], str] = field(default_factory=dict)
    status: dict[str, dict[str, str]] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    day_first: dict[str, bool] = field(default_factory=dict)


def published() -> Rules:
    """The rules of the six programs as they are known; ``learn_rules`` finds them from pairs."""
    severity = ["OK", "WARN", "FAULT"]
    words = {"F1": severity, "F2": list("012"), "F3": severity, "F4": list("OWF"), "F5": ["RUN", "WRN", "FLT"], "F6": ["ok", "warn", "fault"]}
    american = {(lay, f): c for lay in ("F1", "F5") for f, c in (("temp", "fahrenheit"), ("pres", "psi"))}
    return Rules(
        numbers=american | {("F4", f): "in tenths" for f in ("temp", "pres")},
        status={lay: dict(zip(w, severity)) for lay, w in words.items()},
        types={t[0]: t for t in ("PMP", "CMP", "FAN", "VLV")},
        day_first={"F3": True, "F5": False},
    )


def _lookup(table: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def _f3(raw: Column, key: str) -> Column:
    value = r"(\d\d/\d\d/\d{4} \d\d:\d\d)" if key == "time" else r"(\S+)"
    return F.regexp_extract(raw, rf"(?:^| ){key}={value}(?= |$)", 1)


def layout_of(raw: Column) -> Column:
    """F1 to F6, the first that fits; null for none."""
    c = None
    for name, (pattern, _) in LAYOUTS.items():
        c = F.when(raw.rlike(pattern), name) if c is None else c.when(raw.rlike(pattern), name)
    pair = r"(?:time=\d\d/\d\d/\d{4} \d\d:\d\d|(?:dev|site|temp|pressure|flag)=[^ =]+)"
    f3 = raw.rlike(rf"^{pair}(?: {pair}){{5}}$")
    for k in F3_KEYS:
        f3 = f3 & (_f3(raw, k) != "")
    return c.when(f3, "F3")


def line_fields(df: DataFrame, raw: str = "raw_line") -> DataFrame:
    """df with layout and the raw texts type, number, site, time, temp, pres, status of each line (null without layout)."""
    r = F.col(raw)
    d = df.withColumn("layout", layout_of(r))
    out: dict[str, Column] = {}
    for name in ("type", "number", "site", "time", "temp", "pres", "status"):
        c = F.lit(None).cast("string")
        for lay, (pattern, fields) in LAYOUTS.items():
            c = F.when(F.col("layout") == lay, F.regexp_extract(r, pattern, fields.index(name) + 1)).otherwise(c)
        f3 = {
            "type": F.regexp_extract(_f3(r, "dev"), r"^([A-Z]{3})\d{4}$", 1),
            "number": F.regexp_extract(_f3(r, "dev"), r"^[A-Z]{3}(\d{4})$", 1),
            "site": _f3(r, "site"),
            "time": _f3(r, "time"),
            "temp": F.regexp_extract(_f3(r, "temp"), r"^(-?\d+\.\d+)C$", 1),
            "pres": F.regexp_extract(_f3(r, "pressure"), r"^(-?\d+\.\d+)kPa$", 1),
            "status": _f3(r, "flag"),
        }[name]
        out[f"raw_{name}"] = F.when(F.col("layout") == "F3", f3).otherwise(c)
    return d.withColumns(out)


def local_time(layout: Column, time: Column, day_first: dict[str, bool]) -> Column:
    """The printed time as a time stamp of its own clock; null for a text that is no date."""

    def slash(lay: str, year: str, rest: str, fmt: str) -> Column:
        d, m = ("$1", "$2") if day_first.get(lay, True) else ("$2", "$1")
        return F.try_to_timestamp(F.regexp_replace(time, rf"^(\d\d)/(\d\d)/{year} (.*)$", f"{rest}-{m}-{d} $4"), F.lit(fmt))

    return (
        F.when(layout == "F1", F.try_to_timestamp(time, F.lit("yyyy-MM-dd HH:mm:ss")))
        .when(layout == "F2", F.try_to_timestamp(time, F.lit("yyyyMMddHHmmss")))
        .when(layout == "F3", slash("F3", r"(\d{4})", "$3", "yyyy-MM-dd HH:mm"))
        .when(layout == "F4", F.try_to_timestamp(F.concat(F.lit("20"), time), F.lit("yyyyMMddHHmm")))
        .when(layout == "F5", slash("F5", r"(\d\d)", "20$3", "yyyy-MM-dd hh:mma"))
        .when(layout == "F6", F.timestamp_seconds(time.try_cast("long")))
    )


def converted(x: Column, conversion: str) -> Column:
    add, factor = CONVERSIONS[conversion]
    return (x + F.lit(add)) * F.lit(factor)


def one_decimal(x: Column) -> Column:
    # format_string turns null into a text
    return F.when(x.isNotNull(), F.format_string("%.1f", F.round(x, 1) + F.lit(0.0)))


def transduce(lines: DataFrame, sites: DataFrame, rules: Rules | None = None, raw: str = "raw_line") -> DataFrame:
    """lines with ``layout`` and ``output``: the canonical record, or REJECT where no layout fits or a token is unknown.

    sites: site, utc_offset_min; rules are the published ones unless others are given. Numbers are rounded to one decimal after their transform, -0.0 becomes 0.0.
    """
    rules = rules or published()
    d = line_fields(lines, raw)
    s = sites.groupBy("site").agg(F.min("utc_offset_min").alias("_off")).withColumnRenamed("site", "raw_site")
    d = d.join(s, "raw_site", "left")
    lay = F.col("layout")

    def number(name: str) -> Column:
        x = F.col(f"raw_{name}").try_cast("double")
        c = x
        for (l, f), t in rules.numbers.items():
            if f == name:
                c = F.when(lay == l, converted(x, t)).otherwise(c)
        return c

    status = F.lit(None).cast("string")
    for l, table in rules.status.items():
        status = F.when(lay == l, _lookup(table, F.col("raw_status"))).otherwise(status)
    kind = F.when(lay.isin("F2", "F4"), _lookup(rules.types, F.col("raw_type"))).otherwise(F.nullif(F.col("raw_type"), F.lit("")))
    local = local_time(lay, F.col("raw_time"), rules.day_first)
    utc = F.when(lay.isin("F2", "F6"), local).otherwise(local - F.make_dt_interval(mins=F.col("_off")))
    # concat is null as soon as one part is
    record = F.concat(
        F.lit("ts="), F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("|dev="), kind, F.lit("-"), F.nullif(F.col("raw_number"), F.lit("")),
        F.lit("|site="), F.when(F.col("_off").isNotNull(), F.col("raw_site")), F.lit("|temp_c="), one_decimal(number("temp")),
        F.lit("|pres_kpa="), one_decimal(number("pres")), F.lit("|status="), status,
    )
    return d.withColumn("output", F.coalesce(record, F.lit("REJECT"))).select(*lines.columns, "layout", "output")


def render(df: DataFrame) -> DataFrame:
    """Test fixture: raw_line of rows (layout, utc timestamp, offset int, type, number int, site, tc, pk double, status)."""
    r = published()
    back = {l: {v: k for k, v in t.items()} for l, t in r.status.items()}
    letter = _lookup({v: k for k, v in r.types.items()}, F.col("type"))
    local = F.col("utc") + F.make_dt_interval(mins=F.col("offset"))
    num = F.lpad(F.col("number").cast("string"), 4, "0")
    f = F.format_string("%.1f", F.round(F.col("tc") * 9 / 5 + 32, 1))
    psi = F.format_string("%.2f", F.round(F.col("pk") / 6.894757, 2))
    tc, pk = F.format_string("%.1f", F.col("tc")), F.format_string("%.1f", F.col("pk"))
    t10, p10 = F.round(F.col("tc") * 10).cast("int"), F.round(F.col("pk") * 10).cast("int")

    def st(l: str) -> Column:
        return _lookup(back[l], F.col("status"))

    def fmt(p: str, at: Column = local) -> Column:
        return F.date_format(at, p)

    lines = {
        "F1": F.concat(fmt("yyyy-MM-dd HH:mm:ss"), F.lit(" | "), "type", F.lit("-"), num, F.lit(" @ "), "site", F.lit(" | T="), f, F.lit("F P="), psi, F.lit("psi | "), st("F1")),
        "F2": F.concat(F.lit("<"), letter, num, F.lit("|"), "site", F.lit("|"), fmt("yyyyMMddHHmmss", F.col("utc")), F.lit("|t:"), tc, F.lit("|p:"), pk, F.lit("|s:"), st("F2"), F.lit(">")),
        "F3": F.concat(F.lit("temp="), tc, F.lit("C dev="), "type", num, F.lit(" time="), fmt("dd/MM/yyyy HH:mm"), F.lit(" site="), "site", F.lit(" flag="), st("F3"), F.lit(" pressure="), pk, F.lit("kPa")),
        "F4": F.concat(letter, num, F.rpad("site", 5, " "), fmt("yyMMddHHmm"), F.format_string("%+05d", t10), F.format_string("%06d", p10), st("F4")),
        "F5": F.concat("site", F.lit(","), "type", F.lit("-"), num, F.lit(","), fmt("MM/dd/yy hh:mma"), F.lit(","), f, F.lit(","), psi, F.lit(","), st("F5")),
        "F6": F.concat(F.lit('{"st":"'), "site", F.lit('","d":"'), "type", F.lit("-"), num, F.lit('","e":'), F.unix_seconds("utc").cast("string"), F.lit(',"tc":'), tc, F.lit(',"pk":'), pk, F.lit(',"x":"'), st("F6"), F.lit('"}')),
    }
    c = F.lit(None).cast("string")
    for l, x in lines.items():
        c = F.when(F.col("layout") == l, x).otherwise(c)
    return df.withColumn("raw_line", c)


def canonical_value(c: Column, key: str) -> Column:
    """The value of a key in a canonical record; the first of repeated keys counts."""
    return F.regexp_extract(c, rf"(?:^|\|){key}=([^|]*)", 1)


def field_accuracy(df: DataFrame, truth: str = "canonical", output: str = "output") -> DataFrame:
    """df with ``accuracy``: right fields over max(6, pieces of the output); REJECT is right only for REJECT."""
    out = F.trim(F.coalesce(F.col(output), F.lit("")))
    hits = sum(((canonical_value(out, k) == canonical_value(F.col(truth), k)) & out.rlike(rf"(^|\|){k}=")).cast("int") for k in FIELDS)
    score = hits / F.greatest(F.lit(6), F.size(F.split(out, r"\|")))
    return df.withColumn(
        "accuracy", F.when(F.col(truth) == "REJECT", (out == "REJECT").cast("double")).when((out == "") | (out == "REJECT"), 0.0).otherwise(score)
    )


# ---------------------------------------------------------------- learning the rules


def learn_vocabulary(pairs: DataFrame) -> DataFrame:
    """(layout, raw, meaning, n, ambiguous): what each printed status stands for, from lines with a canonical record."""
    d = line_fields(pairs).filter("layout IS NOT NULL AND canonical <> 'REJECT'")
    n = d.groupBy("layout", F.col("raw_status").alias("raw"), canonical_value(F.col("canonical"), "status").alias("meaning")).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("meaning").alias("m")))
    return n.groupBy("layout", "raw").agg(best["m"].alias("meaning"), F.sum("n").alias("n"), (F.count("*") > 1).alias("ambiguous"))


def _utc(pairs: DataFrame) -> DataFrame:
    return line_fields(pairs).filter("layout IS NOT NULL AND canonical <> 'REJECT'").withColumn(
        "utc", F.try_to_timestamp(canonical_value(F.col("canonical"), "ts"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )


def learn_offsets(pairs: DataFrame, *layouts: str) -> DataFrame:
    """(site, utc_offset_min, n): the most frequent difference between printed and canonical minutes of each site, by lines of ``layouts`` (F1)."""
    d = _utc(pairs).filter(F.col("layout").isin(*(layouts or ("F1",))))
    mins = F.floor((F.unix_seconds(local_time(F.col("layout"), F.col("raw_time"), {})) - F.unix_seconds("utc")) / 60).cast("int")
    n = d.groupBy(F.col("raw_site").alias("site"), mins.alias("m")).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("m")))
    return n.groupBy("site").agg(best["m"].alias("utc_offset_min"), F.sum("n").alias("n"))


def learn_numbers(pairs: DataFrame) -> DataFrame:
    """(layout, field, transform, max_error): the one of CONVERSIONS with the smallest largest error."""
    d = _utc(pairs)
    parts = []
    for name, key in (("temp", "temp_c"), ("pres", "pres_kpa")):
        x, y = F.col(f"raw_{name}").try_cast("double"), canonical_value(F.col("canonical"), key).try_cast("double")
        errs = [F.max(F.abs(F.round(converted(x, t), 1) - y)).alias(f"e{i}") for i, t in enumerate(CONVERSIONS)]
        e = d.groupBy("layout").agg(*errs)
        best = F.array_min(F.array(*[F.struct(F.round(f"e{i}", 6).alias("e"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(CONVERSIONS)]))
        parts.append(e.select("layout", F.lit(name).alias("field"), best["t"].alias("transform"), best["e"].alias("max_error")))
    return parts[0].unionByName(parts[1])


def date_order_evidence(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """(layout, day_first, month_first): how many lines each order of slash dates explains exactly."""
    d = _utc(pairs).filter(F.col("layout").isin("F3", "F5")).join(sites.select(F.col("site").alias("raw_site"), "utc_offset_min"), "raw_site")

    def hits(first: bool) -> Column:
        t = local_time(F.col("layout"), F.col("raw_time"), {"F3": first, "F5": first}) - F.make_dt_interval(mins=F.col("utc_offset_min"))
        return F.sum(F.coalesce((t == F.col("utc")).cast("int"), F.lit(0)))

    return d.groupBy("layout").agg(hits(True).alias("day_first"), hits(False).alias("month_first"))


def learn_types(pairs: DataFrame) -> DataFrame:
    """(letter, type, n): the type that a single letter stands for, the most frequent if several."""
    d = _utc(pairs).filter(F.length("raw_type") == 1)
    n = d.groupBy(F.col("raw_type").alias("letter"), F.regexp_extract(canonical_value(F.col("canonical"), "dev"), r"^([A-Z]+)-", 1).alias("t")).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("t")))
    return n.groupBy("letter").agg(best["t"].alias("type"), F.sum("n").alias("n"))


def learn_rules(pairs: DataFrame) -> tuple[Rules, DataFrame]:
    """(rules, site offsets) found from lines with their canonical records (raw_line, canonical), for ``transduce``.

    Offsets come from the layouts with an unambiguous date and a local clock, F1 and F4. What reaches the driver is a row a layout
    and word; the sites stay a table.
    """
    offsets = learn_offsets(pairs, "F1", "F4")
    status: dict[str, dict[str, str]] = {}
    for r in learn_vocabulary(pairs).collect():
        status.setdefault(r["layout"], {})[r["raw"]] = r["meaning"]
    numbers = {(r["layout"], r["field"]): r["transform"] for r in learn_numbers(pairs).collect()}
    types = {r["letter"]: r["type"] for r in learn_types(pairs).collect()}
    order = {r["layout"]: r["day_first"] >= r["month_first"] for r in date_order_evidence(pairs, offsets).collect()}
    return Rules(numbers, status, types, order), offsets


def exact_matches(df: DataFrame, truth: str = "canonical", output: str = "output") -> DataFrame:
    """(layout, n, exact): lines of each layout, and the share whose output is the canonical record to the letter."""
    return df.groupBy("layout").agg(F.count("*").alias("n"), F.avg(F.coalesce((F.col(output) == F.col(truth)).cast("double"), F.lit(0.0))).alias("exact"))
