"""Physical log lines to entries, and entries to fields.

An entry starts at a line that neither starts with white space nor lies within an open quote or
brace; lines starting with # belong to none. Which lines those are depends on all lines before in
the stream, so a stream is cut into blocks of consecutive line numbers. Each block is summarised by
what it does to the three states (plain, in a quote, in a brace), the summaries are scanned in
order, and every line then knows the block that owns its entry. The text is shuffled once by
(stream, owning block); a stream of any length is spread over its blocks.

Entries are parsed by a weighted grammar (Earley, highest score). Parsing depends on an
entry's sequence of lexeme classes alone, so each worker parses a sequence once and keeps the result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions.earley import Grammar, Parse, parse
from shoal.session import python_partitions

BLOCK_LINES = 4096

# ---------------------------------------------------------------- lexemes and grammar

NUM = r"(?:-?\d+(?:[.,]\d+)?|--|null)"
# fixed values: units as the programs print them
TEMP_UNIT = r"(?:°C|degC|°F|degF|kelvin|C|F|K)"
PRES_UNIT = r"(?:kPa|KPA|MPa|hPa|mbar|bar|BAR|psi|PSI|lbf/in2)"
DEV = r"(?:PMP|CMP|FAN|VLV)"
CODE = r"[A-Z]{2,4}\d?"

LEXEMES = [
    ("iso", r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)?(?!\w)"),
    ("plain", r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?!\w)"),
    ("dmon", r"\d\d-[A-Z][a-z]{2}-\d{4} \d\d:\d\d:\d\d(?!\w)"),
    ("slash12", r"\d\d/\d\d/\d\d \d\d:\d\d[AP]M(?!\w)"),
    ("packed", r"[PCFV]\d{4}[A-Z0-9]{2,5} {0,3}\d{10}(?:[+-]\d{5}|[-*? ]{6})(?:\d{7}|[-*? ]{7})[OWF](?!\w)"),
    ("stamp14", r"\d{14}(?!\w)"),
    (
        "kv",
        rf"(?:time=\d\d/\d\d/\d{{4}} \d\d:\d\d|temp={NUM}{TEMP_UNIT}?|pressure={NUM}{PRES_UNIT}?|dev={DEV}-?\d{{4}}"
        rf'|site={CODE}|flag=(?:OK|WARN|FAULT)|msg="[^"]*")(?=\s|$)',
    ),
    (
        "js",
        rf'"(?:e":\d+|t":(?:{NUM})|p":(?:{NUM})|d":"{DEV}-\d{{4}}"|st":"{CODE}"|x":"(?:ok|warn|fault)"'
        rf'|u":"{TEMP_UNIT}/{PRES_UNIT}"|m":"(?:[^"\\]|\\.)*")(?=[,}}\n]|$)',
    ),
    ("dev1", r"(?<=<)[PCFV]\d{4}(?=\|)"),
    ("dev", rf"{DEV}-\d{{4}}(?!\w)"),
    ("kT", r"(?<= )T=(?=[-\dn])"),
    ("kP", r"(?<= )P=(?=[-\dn])"),
    ("kt", r"(?<=\|)t:"),
    ("kp", r"(?<=\|)p:"),
    ("ks", r"(?<=\|)s:"),
    ("km", r"(?<=\|)m:"),
    ("ktemp", r"(?m:^)temp:"),
    ("kpress", r"(?m:^)press:"),
    ("knote", r"(?m:^)note:"),
    ("temp", rf"{NUM} ?{TEMP_UNIT}(?!\w)"),
    ("pres", rf"{NUM} ?{PRES_UNIT}(?!\w)"),
    ("num", rf"{NUM}(?![\w.])"),
    ("level", r"(?:INFO|WARNING|ERROR|OK|WARN|FAULT|RUN|WRN|FLT|Ok|Warn|Fault)(?!\w)"),
    ("zone", r"UTC[+-]\d\d:?\d\d(?!\w)"),
    ("code", rf"{CODE}(?!\w)"),
    ("quoted", r'"(?:[^"]|"")*"'),
    ("txt", r'[^\W\d_][^\n"|<>{}]*'),
    ("eq3", r"==="),
    ("bar", r"\|"),
    ("lt", r"<"),
    ("gt", r">"),
    ("lp", r"\("),
    ("rp", r"\)"),
    ("lb", r"\["),
    ("rb", r"\]"),
    ("cm", r","),
    ("sc", r";"),
    ("co", r":"),
    ("sl", r"/"),
    ("at", r"@"),
    ("oc", r"\{"),
    ("cc", r"\}"),
    ("nl", r"\n"),
    ("sp", r"[^\S\n]+"),
    ("oth", r"(?s:.)"),
]
LEXER = re.compile("|".join(f"(?P<{n}>{p})" for n, p in LEXEMES))

GRAMMAR_TEXT = """
ENTRY -> AGENT | BLOCK | BUS | PAIRS | NODE | SHEET | TAPE | VIGIL
// header, then fields, then remark and continuation lines
AGENT -> iso:stamp_iso sp lb level:level rb sp dev:dev sl code:site sp lp HEAT sc sp PRESS rp AGENTTAIL
AGENTTAIL -> co sp REMARK | CONT
VIGIL -> plain:stamp_plain sp bar sp dev:dev sp at sp code:site sp bar sp kT HEAT sp kP PRESS sp bar sp level:level VIGILTAIL
VIGILTAIL -> sp bar sp REMARK | CONT
SHEET -> code:site cm dev:dev cm slash12:stamp_slash12 cm num:temp cm num:pres cm level:level SHEETTAIL
SHEETTAIL -> cm quoted:qmsg CONT | cm REMARK [-0.5] | CONT
BUS -> lt dev1:dev1 bar code:site bar stamp14:stamp_14 bar kt num:temp bar kp num:pres bar ks num:level BUSTAIL gt CONT
BUSTAIL -> bar km REMARK | <empty>
TAPE -> packed:packed TAPETAIL
TAPETAIL -> sp REMARK | CONT
PAIRS -> kv:kv MOREPAIRS
MOREPAIRS -> sp kv:kv MOREPAIRS | CONT
NODE -> oc GAP js:js MOREJS GAP cc CONT
MOREJS -> GAP cm GAP js:js MOREJS | <empty>
GAP -> nl | sp | <empty>
BLOCK -> eq3 sp dmon:stamp_dmon sp ZONE sp level:level sp dev:dev sp lp code:site rp BLOCKLINES
ZONE -> zone:zone | code:zone
BLOCKLINES -> nl HEATLINE nl PRESSLINE BLOCKTAIL | nl PRESSLINE nl HEATLINE BLOCKTAIL
HEATLINE -> ktemp sp HEAT
PRESSLINE -> kpress sp PRESS
BLOCKTAIL -> nl knote sp REMARK | CONT
HEAT -> temp:temp | num:temp
PRESS -> pres:pres | num:pres
CONT -> nl:msg REMARK | <empty>
REMARK -> REMARK ANY [-1] | ANY [-1]
"""
_CLASSES = [n for n, _ in LEXEMES]
GRAMMAR = Grammar(GRAMMAR_TEXT + "ANY -> " + " | ".join(f"{c}:msg" for c in _CLASSES))

# fixed values: level words, letters and digits of rising severity
LEVELS = {
    **dict.fromkeys(("INFO", "OK", "RUN", "Ok", "ok", "0", "O"), "OK"),
    **dict.fromkeys(("WARNING", "WARN", "WRN", "Warn", "warn", "1", "W"), "WARN"),
    **dict.fromkeys(("ERROR", "FAULT", "FLT", "Fault", "fault", "2", "F"), "FAULT"),
}
FIRST_LETTER = {"P": "PMP", "C": "CMP", "F": "FAN", "V": "VLV"}
_READING = re.compile(rf"^({NUM}) ?(.*)$", re.S)
_PACKED = re.compile(r"^([PCFV])(\d{4})(.{5})(\d{10})(.{6})(.{7})([OWF])$")

FIELDS = (
    "line_id string, stream string, line_no long, arrived timestamp, ok boolean, layout string, level string, component string, message string, "
    "site string, stamp_kind string, stamp string, zone string, temp_raw string, temp_unit string, "
    "pres_raw string, pres_unit string, score double, unparsed string"
)
_NAMES = [f.strip().split()[0] for f in FIELDS.split(",")]


def _reading(text: str) -> tuple[str | None, str | None]:
    m = _READING.match(text)
    if not m or m[1] in ("--", "null"):
        return None, (m[2] or None) if m else None
    return m[1].replace(",", "."), m[2] or None


class EntryParser:
    """Parses entry texts; remembers the parse of every sequence of lexeme classes it has met."""

    def __init__(self, grammar: Grammar = GRAMMAR, keep: int = 50_000):
        self.grammar, self.keep = grammar, keep
        self.seen: dict[tuple, Parse] = {}

    def parse(self, text: str) -> tuple[Parse, list[re.Match]]:
        toks = list(LEXER.finditer(text))
        shape = tuple(t.lastgroup for t in toks)
        p = self.seen.get(shape)
        if p is None:
            if len(self.seen) >= self.keep:
                self.seen.clear()
            # a remark of any length is explained token by token; only its first few classes can matter
            p = self.seen[shape] = parse(self.grammar, shape)
        return p, toks

    def fields(self, text: str) -> dict:
        """The entry's fields; ``ok`` is false and ``unparsed`` holds the rest where no layout fits."""
        p, toks = self.parse(text)
        out: dict = dict.fromkeys(_NAMES)
        out["ok"], out["score"] = False, p.score
        if not p.ok:
            at = toks[p.reached].start() if p.reached < len(toks) else len(text)
            out["unparsed"] = text[at:]
            return out
        msg: list[str] = []
        keys: list[str] = []
        for field, i in p.fields:
            t = toks[i].group()
            if field == "msg":
                msg.append(t)
            elif field == "qmsg":
                msg.append(t[1:-1].replace('""', '"'))
            elif field in ("temp", "pres"):
                out[f"{field}_raw"], out[f"{field}_unit"] = _reading(t)
            elif field == "level":
                out["level"] = LEVELS.get(t)
            elif field == "dev":
                out["component"] = t
            elif field == "dev1":
                out["component"] = f"{FIRST_LETTER[t[0]]}-{t[1:]}"
            elif field.startswith("stamp_"):
                out["stamp_kind"], out["stamp"] = field[6:], t
            elif field == "packed":
                self._packed(t, out)
            elif field == "kv":
                keys.append(self._pair(t, out, msg))
            elif field == "js":
                keys.append(self._member(t, out, msg))
            else:
                out[field] = t
        if keys and len(set(keys)) < len(keys):
            out["unparsed"] = text
            return out
        if out["stamp_kind"] == "iso" and (m := re.search(r"(Z|[+-]\d\d:?\d\d)$", out["stamp"])):
            out["zone"], out["stamp"] = m[1], out["stamp"][: m.start()]
        complete = all(out[k] is not None for k in ("level", "component", "site", "stamp"))
        if keys:
            complete = complete and {"temp", "pressure"} <= set(keys) or {"t", "p"} <= set(keys) and complete
        out["ok"] = bool(complete)
        if not complete:
            out["unparsed"] = text
        out["message"] = "".join(msg).replace("\n", " ").strip()
        out["layout"] = out["stamp_kind"]
        return out

    @staticmethod
    def _packed(t: str, out: dict) -> None:
        m = _PACKED.match(t)
        if not m or not re.fullmatch(CODE, m[3].rstrip()):
            return
        out["component"], out["site"] = f"{FIRST_LETTER[m[1]]}-{m[2]}", m[3].rstrip()
        out["stamp_kind"], out["stamp"], out["level"] = "packed", m[4], LEVELS[m[7]]
        out["temp_raw"] = m[5] if m[5][1:].isdigit() else None
        out["pres_raw"] = m[6] if m[6].isdigit() else None
        out["temp_unit"] = out["pres_unit"] = "packed"

    @staticmethod
    def _pair(t: str, out: dict, msg: list[str]) -> str:
        k, _, v = t.partition("=")
        if k == "time":
            out["stamp_kind"], out["stamp"] = "slash24", v
        elif k == "temp":
            out["temp_raw"], out["temp_unit"] = _reading(v)
        elif k == "pressure":
            out["pres_raw"], out["pres_unit"] = _reading(v)
        elif k == "dev":
            out["component"] = v if "-" in v else f"{v[:3]}-{v[3:]}"
        elif k == "site":
            out["site"] = v
        elif k == "flag":
            out["level"] = LEVELS[v]
        elif k == "msg":
            msg.insert(0, v[1:-1])
        return k

    @staticmethod
    def _member(t: str, out: dict, msg: list[str]) -> str:
        k, _, v = t[1:].partition('":')
        if k == "e":
            out["stamp_kind"], out["stamp"] = "epoch", v
        elif k == "t":
            out["temp_raw"] = _reading(v)[0]
        elif k == "p":
            out["pres_raw"] = _reading(v)[0]
        elif k == "d":
            out["component"] = v[1:-1]
        elif k == "st":
            out["site"] = v[1:-1]
        elif k == "x":
            out["level"] = LEVELS[v[1:-1]]
        elif k == "u":
            out["temp_unit"], out["pres_unit"] = v[1:-1].split("/", 1)
        elif k == "m":
            msg.insert(0, json.loads(v, strict=False) if "\\" in v else v[1:-1])
        return k


# ---------------------------------------------------------------- lines to entries

PLAIN, QUOTE, BRACE = 0, 1, 2
_OPENS_QUOTE = rf'^(?:{CODE},{DEV}-\d{{4}},|.*\bmsg=")'


def _count(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def line_moves(raw: Column) -> dict[str, Column]:
    """What a line does: ``start`` (it would start an entry) and the next state from each state."""
    raw = F.coalesce(raw, F.lit(""))
    comment = raw.startswith("#")
    starts = ~comment & raw.rlike(r"^\S")
    odd = ~comment & (_count(raw, '"') % 2 == 1)
    net = _count(raw, "{") - _count(raw, "}")
    opens_b = starts & raw.startswith("{") & (net > 0)
    return {
        "start": starts,
        "from_plain": F.when(opens_b, BRACE).when(starts & odd & raw.rlike(_OPENS_QUOTE), QUOTE).otherwise(PLAIN),
        "from_quote": F.when(odd, PLAIN).otherwise(QUOTE),
        "from_brace": F.when(~comment & (net < 0), PLAIN).otherwise(BRACE),
    }


def block_owners(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(stream, block, owner, first_start) of every block but a stream's first.

    Lines of the block before first_start (all, where it is null) belong to the entry that was
    begun in block ``owner`` (null: to none). One row per block_lines lines; the scan over a stream's
    blocks holds one row at a time.
    """
    moves = line_moves(F.col("raw_line"))
    narrow = lines.select(
        "stream",
        F.floor((F.col("line_no") - 1) / block_lines).alias("block"),
        F.struct("line_no", *[c.cast("int").alias(k) for k, c in moves.items()]).alias("m"),
    )

    def step(acc: Column, m: Column) -> Column:
        out = []
        for s in "npb":
            state, first = acc[f"s{s}"], acc[f"f{s}"]
            out.append(F.when(state == PLAIN, m["from_plain"]).when(state == QUOTE, m["from_quote"]).otherwise(m["from_brace"]).alias(f"s{s}"))
            out.append(F.coalesce(first, F.when((state == PLAIN) & (m["start"] == 1), m["line_no"])).alias(f"f{s}"))
        return F.struct(*out)

    zero = F.struct(
        *[x for s, k in zip("npb", (PLAIN, QUOTE, BRACE)) for x in (F.lit(k).alias(f"s{s}"), F.lit(None).cast("long").alias(f"f{s}"))]
    )
    # a block holds block_lines lines at most, so its list is bounded; a set, as repeated rows count once
    blocks = narrow.groupBy("stream", "block").agg(F.aggregate(F.array_sort(F.collect_set("m")), zero, step).alias("b")).select("stream", "block", "b.*")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, state, owner = None, PLAIN, None
        for pdf in batches:
            rows = []
            cols = [pdf[c].tolist() for c in ("stream", "block", "sn", "sp", "sb", "fn", "fp", "fb")]
            for st, block, sn, sp, sb, fn, fp, fb in zip(*cols):
                if st != stream:
                    stream, state, owner = st, PLAIN, None
                first = (fn, fp, fb)[state]
                first = None if first is None or first != first else int(first)
                if block > 0:
                    rows.append((st, block, owner, first))
                if first is not None:
                    owner = block
                state = (sn, sp, sb)[state]
            yield pd.DataFrame(rows, columns=["stream", "block", "owner", "first_start"]).astype({"owner": "Int64", "first_start": "Int64"})

    return (
        blocks.repartition("stream")
        .sortWithinPartitions("stream", "block")
        .mapInPandas(scan, "stream string, block long, owner long, first_start long")
    )


def _scan_entries(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(line_id, stream, line_no, arrived, lines) of each entry of lines sorted by (stream, home, line_no)."""
    at, cur, state, last = None, None, PLAIN, None
    for pdf in batches:
        cols = (pdf[c].tolist() for c in ("line_id", "stream", "home", "line_no", "raw_line", "arrived", "start", "from_plain", "from_quote", "from_brace"))
        for line_id, stream, home, line_no, raw, arrived, start, fp, fq, fb in zip(*cols):
            if (stream, home) != at:
                if cur:
                    yield cur
                at, cur, state, last = (stream, home), None, PLAIN, None
            if line_no == last:
                continue
            last = line_no
            if state == PLAIN and start:
                if cur:
                    yield cur
                cur = (line_id, stream, line_no, arrived, [raw])
            elif cur and raw is not None and not raw.startswith("#"):
                cur[4].append(raw)
            state = (fp, fq, fb)[state]
    if cur:
        yield cur


def _parse_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parser, rows = EntryParser(), []
    for line_id, stream, line_no, arrived, lines in _scan_entries(batches):
        f = parser.fields("\n".join(x for x in (y.strip() for y in lines) if x))
        f["line_id"], f["stream"], f["line_no"], f["arrived"] = line_id, stream, line_no, arrived
        rows.append(tuple(f[k] for k in _NAMES))
        if len(rows) >= 4096:
            yield pd.DataFrame(rows, columns=_NAMES)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=_NAMES)


def log_entries(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Every entry of the streams with its fields, one row each, named by its first line's line_id.

    lines: line_id, stream, line_no (from 1), raw_line and, if there, received_at (comes out as
    ``arrived``); other columns are ignored. Entries that fit no
    layout come out with ok = false and the text from where every parse broke off in ``unparsed``.
    Lines before a stream's first entry, comments and lines without stream or number are part of no
    entry. A null raw_line counts as a blank line. Rows with one stream and
    line number count once. An entry whose quote or brace never closes goes on to the end of its stream. An empty
    table gives no rows.
    """
    arrived = F.col("received_at") if "received_at" in lines.columns else F.lit(None)
    lines = lines.filter(F.col("stream").isNotNull() & F.col("line_no").isNotNull()).select(
        "line_id", "stream", F.col("line_no").cast("long").alias("line_no"), "raw_line", arrived.cast("timestamp").alias("arrived")
    )
    block = F.floor((F.col("line_no") - 1) / block_lines)
    head = lines.filter(F.col("line_no") <= block_lines).withColumn("home", F.lit(0).cast("long"))
    rest = (
        lines.filter(F.col("line_no") > block_lines)
        .withColumn("block", block)
        .join(block_owners(lines, block_lines), ["stream", "block"])
        .withColumn("home", F.when(F.col("line_no") < F.coalesce("first_start", F.lit(2**62)), F.col("owner")).otherwise(F.col("block")))
        .filter(F.col("home").isNotNull())
        .select("line_id", "stream", "line_no", "raw_line", "arrived", "home")
    )
    placed = head.unionByName(rest)
    return (
        placed.repartition(python_partitions(lines), "stream", "home")
        .sortWithinPartitions("stream", "home", "line_no", "line_id")
        .select("*", *[c.alias(k) for k, c in line_moves(F.col("raw_line")).items()])
        .mapInPandas(_parse_partition, FIELDS)
    )
