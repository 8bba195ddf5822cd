"""Earley parsing, entry assembly in blocks, and fields of each layout."""

import itertools
import random

from shoal.functions.earley import Grammar, parse
from shoal.operators.loglines import EntryParser, log_entries


def test_earley_keeps_the_best_derivation():
    g = Grammar("S -> A B | X\nA -> a:first | a a:first [-1]\nB -> b:second B [-0.5] | b:second\nX -> a b:whole [-3]")
    p = parse(g, ["a", "b"])
    assert p.ok and p.score == 0 and p.fields == (("first", 0), ("second", 1))
    p = parse(g, ["a", "a", "b", "b"])
    assert p.score == -1.5 and p.fields == (("first", 1), ("second", 2), ("second", 3))


def test_earley_reports_where_it_stops():
    g = Grammar("S -> a b c")
    p = parse(g, ["a", "b", "x", "c"])
    assert not p.ok and p.reached == 2
    assert parse(g, []).reached == 0 and not parse(g, ["a"]).ok


def test_earley_against_enumeration():
    text = "S -> S S [-0.3] | a [-1] | b T | <empty> [-2]\nT -> a T [-0.1] | <empty>"
    g = Grammar(text)

    def best(tokens, depth=6):
        """Best score of S over tokens by trying all splits, to a bounded depth."""
        from functools import lru_cache

        @lru_cache(None)
        def t(i, j):
            return 0.0 if i == j else (t(i + 1, j) - 0.1 if tokens[i] == "a" and t(i + 1, j) is not None else None)

        @lru_cache(None)
        def s(i, j, d):
            if d == 0:
                return None
            c = [-2.0] if i == j else []
            if j - i == 1 and tokens[i] == "a":
                c.append(-1.0)
            if i < j and tokens[i] == "b" and t(i + 1, j) is not None:
                c.append(t(i + 1, j))
            for k in range(i + 1, j):
                x, y = s(i, k, d - 1), s(k, j, d - 1)
                if x is not None and y is not None:
                    c.append(x + y - 0.3)
            return max(c) if c else None

        return s(0, len(tokens), depth)

    for n in range(5):
        for tokens in itertools.product("ab", repeat=n):
            want, got = best(tokens), parse(g, tokens)
            assert got.ok and abs(got.score - want) < 1e-9, tokens


CASES = {
    "2025-03-09T02:00:40.390000Z [INFO] VLV-0017/KIF3 (274.35 K; 5635 mbar): Relay needs a new gasket.\nheld back 46 packets": ("OK", "VLV-0017", "Relay needs a new gasket. held back 46 packets", "274.35", "K"),
    "2025-03-09T05:13:32+0100 [ERROR] FAN-3437/RE5 (-- °C; 0,4656 MPa)": ("FAULT", "FAN-3437", "", None, "°C"),
    "=== 05-Feb-2025 08:51:50 UTC+05:45 Warn CMP-0027 (MOF5)\npress: 6579 mbar\ntemp: 84,6 °C\nnote: gauge glass: retry 3\nretry 21": ("WARN", "CMP-0027", "gauge glass: retry 3 retry 21", "84.6", "°C"),
    "<F0020|DI6|20250308183631|t:113.9|p:90.40|s:0>": ("OK", "FAN-0020", "", "113.9", None),
    "<V6165|RE5|20250309031433|t:--|p:22.47|s:2|m:Inlet strainer cleared.>": ("FAULT", "VLV-6165", "Inlet strainer cleared.", None, None),
    'dev=PMP1781 site=VAK3 pressure=7.701BAR time=05/06/2025 04:18 temp=-3.1 flag=WARN msg="Seal reads late - ticket 145."': ("WARN", "PMP-1781", "Seal reads late - ticket 145.", "-3.1", None),
    '{\n"st":"VAK3",\n"d":"FAN-0027",\n"e":1763332190,\n"t":null,\n"p":2121,\n"x":"ok",\n"u":"K/hPa",\n"m":"Bus \\"A\\" left open"\n}': ("OK", "FAN-0027", 'Bus "A" left open', None, "K"),
    'DI6,VLV-5307,08/03/25 06:54PM,107.2,99.70,RUN,"Relay shows rust, see shift book.\nCaused by: no answer on channel 1"': ("OK", "VLV-5307", "Relay shows rust, see shift book. Caused by: no answer on channel 1", "107.2", None),
    "P3078DEB2 2511181223-006750008963W shaft sleeve hums at low load": ("WARN", "PMP-3078", "shaft sleeve hums at low load", "-00675", "packed"),
    "2025-11-18 11:28:03 | FAN-2462 @ LEN4 | T=331.65K P=5821mbar | WARN | Guard passed the tap test, ticket 37.": ("WARN", "FAN-2462", "Guard passed the tap test, ticket 37.", "331.65", "K"),
}


def test_layouts():
    p = EntryParser()
    for text, (level, component, message, temp, unit) in CASES.items():
        f = p.fields(text)
        assert f["ok"], (text, f["unparsed"])
        assert (f["level"], f["component"], f["message"], f["temp_raw"], f["temp_unit"]) == (level, component, message, temp, unit), text


def test_damage_is_never_an_entry():
    p = EntryParser()
    for text in CASES:
        first = text.split("\n")[0]
        if "=== " in first:
            continue
        for cut in (5, 12, len(first) // 2):
            f = p.fields(first[:cut])
            assert not f["ok"] and f["unparsed"] is not None
    assert not p.fields("20?5-1%-2& 182742 | VLV-!%92 @ LEN4  T3&3.35kelvin P=8697mbar | OK")["ok"]
    assert not p.fields("dev=PMP1781 dev=PMP1781 site=V1 pressure=7.7BAR time=05/06/2025 04:18 temp=-3.1 flag=OK")["ok"]
    assert not p.fields("")["ok"]


def test_very_long_remark():
    text = "2025-11-18 11:28:03 | FAN-2462 @ LEN4 | T=331.65K P=5821mbar | WARN | " + "word " * 200_000
    f = EntryParser().fields(text)
    assert f["ok"] and len(f["message"]) == 5 * 200_000 - 1


SCHEMA = "line_id string, stream string, line_no int, raw_line string, message string"


def stream_lines(name, entries, seed):
    rnd, lines = random.Random(seed), []
    for e in entries:
        if rnd.random() < 0.2:
            lines.append("# queue flushed")
        parts = e.split("\n")
        quoted = parts[0].count('"') % 2 == 1
        for i, x in enumerate(parts):
            lines.append(x if i == 0 or quoted or parts[0] == "{" and x == "}" else "  " + x + rnd.choice(["", "  ", "\r"]))
            if i < len(parts) - 1 and rnd.random() < 0.3:
                lines.append("   ")
    return [(f"{name}{i}", name, i + 1, x, "clash") for i, x in enumerate(lines)]


def test_blocks_do_not_change_entries(spark, rows):
    rnd = random.Random(3)
    entries = [rnd.choice(list(CASES)) for _ in range(60)]
    data = stream_lines("s1", entries, 1) + stream_lines("s2", entries[:5], 2) + [("x", None, 1, "lost", ""), ("y", "s3", 1, None, ""), ("z", "s3", 2, "  early", "")]
    data += data[:40]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, SCHEMA)
    want = rows(log_entries(df), "line_id", "ok", "message", "component")
    assert len(want) == 65 and all(w[1] for w in want)
    for block in (3, 7, 16):
        assert rows(log_entries(df, block), "line_id", "ok", "message", "component") == want
    by_order = [m for _, m in sorted((int(w[0][2:]), w[2]) for w in want if w[0].startswith("s1"))]
    assert by_order == [CASES[e][2] for e in entries]


def test_empty_table(spark):
    assert log_entries(spark.createDataFrame([], SCHEMA)).count() == 0
