"""Scans, windows, joins, metrics, sequences, transduction, contracts and sources on hand-made frames."""

import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shoal.operators import bars, clean, features, joins, metrics, ranking, scans, sequences, transduce
from shoal.operators.aggregates import average_rank, mode_of, quantile_bucket, ranked
from shoal.operators.contracts import Contract, InvalidData
from shoal.operators.windows import islands, rising_edges, rolling, set_reset



def w_():
    return Window.partitionBy("e").orderBy("t")


T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def series(spark):
    rnd = random.Random(4)
    data = [(e, t, None if rnd.random() < 0.4 else rnd.randrange(100)) for e in ("a", "a2", None) for t in range(120)]
    data += [("void", t, None) for t in range(5)]
    rnd.shuffle(data)
    return spark.createDataFrame([(e, t, v, t // 7, "x") for e, t, v in data], "e string, t int, v int, b int, rn string")


def same(a, b):
    key = lambda r: tuple(str(x) for x in r)
    return sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def test_block_scans_equal_plain_windows(series):
    full = w_().rowsBetween(Window.unboundedPreceding, 0)
    ahead = w_().rowsBetween(0, Window.unboundedFollowing)
    got = scans.fill_forward(series, ["e"], ["t"], "b", ["v"], back=True).select("e", "t", "v")
    assert same(got, series.select("e", "t", F.coalesce(F.last("v", True).over(full), F.first("v", True).over(ahead)).alias("v")))
    assert same(scans.fill_forward(series, ["e"], ["t"], "b", ["v"]).select("e", "t", "v"), series.select("e", "t", F.last("v", True).over(full)))
    for how, fn in (("sum", F.sum), ("max", F.max), ("min", F.min), ("count", F.count)):
        assert same(scans.running(series, ["e"], ["t"], "b", "v", how, "r").select("e", "t", "r"), series.select("e", "t", fn("v").over(full))), how
    assert same(scans.numbered(series, ["e"], ["t"], "b", "n").select("e", "t", "n"), series.select("e", "t", F.row_number().over(w_())))
    cols = {"m": rolling("v", 9, 3, "mean"), "md": rolling("v", 9, 1, "median")}
    want = series.select("e", "t", *[f(w_()).alias(k) for k, f in cols.items()])
    for piece in (10, 16, 500):
        assert same(scans.trailing(series, ["e"], ["t"], "b", 9, cols, piece).select("e", "t", "m", "md"), want), piece
    assert scans.fill_forward(series.limit(0), ["e"], ["t"], "b", ["v"]).count() == 0


def test_as_of(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "a", 5), (4, "b", 10), (5, None, 10), (6, "a", None)], "id int, e string, t long")
    right = spark.createDataFrame([("a", 10, 1), ("a", 10, 2), ("a", 12, 3), ("b", 11, 4), ("a", None, 9), (None, 3, 7)], "e string, u long, v int")
    got = {r["id"]: (r["u"], r["v"]) for r in scans.as_of(left, right, ["e"], "t", "u", "floor(_t / 4)", ["u", "v"]).collect()}
    assert got == {1: (10, 2), 2: (12, 3), 3: (None, None), 4: (None, None), 5: (3, 7), 6: (None, None)}
    strict = {r["id"]: r["v"] for r in scans.as_of(left, right, ["e"], "t", "u", "floor(_t / 4)", ["u", "v"], strict=True).collect()}
    assert strict == {1: None, 2: 3, 3: None, 4: None, 5: 7, 6: None}


def test_rolling_counts_rows_that_are_not_null(spark):
    d = spark.createDataFrame([("a", i, float(i) if i not in (3, 4) else None) for i in range(1, 8)], "e string, t int, v double")
    got = [r[0] for r in d.select("t", rolling("v", 3, 2, "mean")(w_()).alias("m")).orderBy("t").select("m").collect()]
    assert got == [None, 1.5, 1.5, None, None, 5.5, 6.0]
    sd = [r[0] for r in d.select("t", rolling("v", 3, 3, "std")(w_()).alias("m")).orderBy("t").select("m").collect()]
    assert sd == [None, None, None, None, None, None, 1.0]


def test_islands_states_and_edges(spark):
    d = spark.createDataFrame([("a", t, f) for t, f in enumerate([0, 1, 1, 0, 1])], "e string, t int, f int")
    assert sorted(map(tuple, islands(d, ["e"], "t", "f").collect())) == [("a", 1, 2, 2, False), ("a", 4, 4, 1, True)]
    assert [r[0] for r in d.select("t", rising_edges("f", w_()).alias("x")).orderBy("t").select("x").collect()] == [0, 1, 0, 0, 1]
    z = [None, -2.0, None, -0.1, -1.5, 0.3, 1.0]
    s = spark.createDataFrame([("a", t, x) for t, x in enumerate(z)], "e string, t int, z double")
    got = [r[0] for r in s.select("t", set_reset(F.col("z") < -1, F.col("z") > -0.2)(w_()).alias("p")).orderBy("t").select("p").collect()]
    assert got == [0, 1, 1, 0, 1, 0, 0]


def test_hysteresis_equals_the_loop(spark):
    rnd = np.random.default_rng(1)
    c = np.exp(np.cumsum(rnd.normal(0, 0.03, 200)))
    h, lo = c * (1 + rnd.uniform(0, 0.01, 200)), c * (1 - rnd.uniform(0, 0.01, 200))
    d = spark.createDataFrame([("x", i, float(h[i]), float(lo[i]), float(c[i])) for i in range(200)], "arena string, step int, high double, low double, close double")
    got = [r[0] for r in bars.breakout_position(d, 12, 6).orderBy("step").select("pos").collect()]
    state, want = 0, []
    for t in range(200):
        if state == 0:
            state = int(t >= 12 and c[t] > h[t - 12 : t].max())
        elif t >= 6 and c[t] < lo[t - 6 : t].min():
            state = 0
        want.append(state)
    assert got == want
    tr = sorted(map(tuple, bars.trades(bars.breakout_position(d, 12, 6)).select("entry_step", "exit_step", "open_at_cutoff").collect()))
    runs, start = [], None
    for t in range(200):
        if want[t] and start is None:
            start = t
        elif not want[t] and start is not None:
            runs.append((start, t, 0))
            start = None
    if start is not None:
        runs.append((start, 199, 1))
    assert tr == runs


def test_horizon_is_open_then_closed(spark):
    r = spark.createDataFrame([(i, "p", t) for i, t in enumerate([0, 1, 47, 48, 49, 100, 148])] + [(9, None, 5), (10, "q", 5)], "id int, e string, t long")
    f = spark.createDataFrame([("p", 48), ("p", 149), ("p", 149), ("p", None), (None, 6)], "e string, t long")
    got = {x["id"]: x["label"] for x in joins.event_within(r, f, "e", "t", "t", 48).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1, 9: 0, 10: 0}
    rnd = random.Random(2)
    rows = [(i, "p", rnd.randrange(500)) for i in range(200)]
    ev = [rnd.randrange(500) for _ in range(12)]
    got = {x["id"]: x["label"] for x in joins.event_within(spark.createDataFrame(rows, "id int, e string, t long"), spark.createDataFrame([("p", e) for e in ev], "e string, t long"), "e", "t", "t", 30).collect()}
    assert got == {i: int(any(t < e <= t + 30 for e in ev)) for i, _, t in rows}


def test_outside_periods_and_expansion(spark):
    r = spark.createDataFrame([(i, "p", t) for i, t in enumerate([9, 10, 19, 20, 35])] + [(7, None, 15)], "id int, e string, t long")
    p = spark.createDataFrame([("p", 10, 20), ("p", 30, 40)], "e string, start_s long, end_s long")
    assert sorted(x["id"] for x in joins.outside_periods(r, p, "e", "t", 7).collect()) == [0, 3, 7]
    d = spark.createDataFrame([(1, 2, 5), (2, 3, 3), (3, 5, 2), (4, None, 2)], "id int, a int, b int")
    assert sorted((x["id"], x["step"]) for x in joins.expand_steps(d, "a", "b").collect()) == [(1, 2), (1, 3), (1, 4)]


def test_joins_with_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert joins.one_to_one(a, a, ["k"]).columns == ["k", "v_x", "v_y"]
    with pytest.raises(joins.DuplicateKeys):
        joins.one_to_one(a.union(a), a, ["k"])
    m = joins.greedy_match(
        spark.createDataFrame([("s", 1, 0.0), ("s", 2, 0.1), ("t", 3, 1.0)], "g string, k int, f double"),
        spark.createDataFrame([("s", 10, 0.05), ("s", 11, 0.4), ("s", 12, None)], "g string, k int, f double"), "g", "k", ["f"],
    )
    assert sorted((r[0], r[1], r[2]) for r in m.collect()) == [("s", 1, 10), ("s", 2, 11)]
    # a table matched with itself
    assert joins.greedy_match(a.withColumn("f", F.lit(1.0)), a.withColumn("f", F.lit(1.0)), "v", "k", ["f"]).count() == 2


def test_cleaning_traps(spark):
    d = spark.createDataFrame([(" 13085.0 ",), ("76902D",), ("nan",), (None,), ("1e3",), ("",)], "x string")
    assert [r[0] for r in d.select(clean.to_number(F.col("x"))).collect()] == [13085.0, None, None, None, 1000.0, None]
    assert [r[0] for r in d.select(clean.clean_id(F.col("x"))).collect()] == ["13085", "", "", "", "1000", ""]
    assert [r[0] for r in d.select(clean.blank_sentinels(F.col("x"))).collect()] == [" 13085.0 ", "76902D", "", "", "1e3", ""]
    n = spark.createDataFrame([(5.0,), (None,), (float("nan"),), (-999.0,)], "x double")
    assert [r[0] for r in n.select(clean.clip(F.col("x"), 0.0, 3.0)).collect()][:2] == [3.0, None]
    assert [r[0] for r in n.select(clean.is_finite(F.col("x"))).collect()] == [True, False, False, True]
    assert n.select(clean.without_sentinel(F.col("x"))).collect()[3][0] is None
    assert str(spark.range(1).select(clean.round_half_even_free(F.lit(-0.04))).first()[0]) == "0.0"
    e = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert [r["code"] for r in clean.label_encode(e, "c").orderBy("c").collect()] == [-1, 0, 1, 1]


def test_ranks_modes_buckets(spark):
    d = spark.createDataFrame([("g", 1.0), ("g", 1.0), ("g", 2.0), ("g", None)], "g string, x double")
    want = [(1.0, 1.5, 0.5), (1.0, 1.5, 0.5), (2.0, 3.0, 1.0), (None, None, None)]
    assert [tuple(r)[1:] for r in ranked(d, "x", ["g"], "r").orderBy(F.col("x").asc_nulls_last()).collect()] == want
    assert [r[0] for r in d.select("x", average_rank("x", ["g"]).alias("r")).orderBy(F.col("x").asc_nulls_last()).select("r").collect()] == [1.5, 1.5, 3.0, None]
    m = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None), ("g", None), ("h", None)], "g string, v string")
    assert [tuple(r) for r in mode_of(m, ["g"], "v").collect()] == [("g", "a")]
    q = spark.createDataFrame([(float(i),) for i in range(1, 7)] + [(None,)], "x double")
    got = [r["bucket"] for r in quantile_bucket(q, "x", [1 / 3, 2 / 3], ["l", "m", "h"]).orderBy(F.col("x").asc_nulls_last()).collect()]
    assert got == list(pd.qcut(range(1, 7), 3, labels=["l", "m", "h"])) + [None]


def sk_ap(y, s):
    order = sorted(set(s), reverse=True)
    p, tp, n, out = sum(y), 0, 0, 0.0
    for v in order:
        k = sum(a for a, b in zip(y, s) if b == v)
        tp, n = tp + k, n + sum(b == v for b in s)
        out += k / p * tp / n
    return out


def test_ranking_metrics(spark):
    rnd = random.Random(3)
    y = [int(rnd.random() < 0.3) for _ in range(300)]
    s = [round(rnd.random() + 0.4 * v, 1) for v in y]
    d = spark.createDataFrame([("g", a, b) for a, b in zip(y, s)] + [("one", 1, 0.5), ("one", 1, 0.2)], "g string, y int, s double")
    g = d.filter("g = 'g'")
    assert abs(metrics.average_precision(g, "s", "y").first()[0] - sk_ap(y, s)) < 1e-12
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    got = {r["g"]: r["auc"] for r in metrics.auc(d, "s", "y", ["g"]).collect()}
    assert abs(got["g"] - want) < 1e-12 and got["one"] == 0.5
    assert metrics.auc(d.filter("g = 'one'"), "s", "y", single_class=None).first()[0] is None
    const = d.withColumn("s", F.lit(1.0))
    assert metrics.spearman_by_group(const, "s", "y", ["g"]).filter("spearman <> 0").count() == 0


def test_ndcg_and_accuracy(spark):
    r = spark.createDataFrame([("u", "a", 1), ("u", "b", 2), ("v", "x", 1), ("w", "q", 1)], "u string, i string, rank int")
    rel = spark.createDataFrame([("u", "b"), ("u", "c"), ("u", "b"), ("v", "y")], "u string, i string")
    got = {x["u"]: x["ndcg"] for x in metrics.ndcg(r, rel, "u", "i").collect()}
    assert set(got) == {"u", "v"} and got["v"] == 0
    assert abs(got["u"] - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-12
    t = spark.createDataFrame([("u", "b"), ("v", None), ("w", "z")], "u string, i string")
    a = metrics.top_k_accuracy(r, t, "u", "i", "rank", (1, 3)).first()
    assert tuple(a) == (2, 0.0, 0.5)


def test_rank_biased_overlap(spark):
    t = [f"i{k}" for k in range(10)]
    d = spark.createDataFrame([(t, t, [x if k in (1, 4, 6) else None for k, x in enumerate(t)], t[::-1], [None] * 10)], "a array<string>, b array<string>, p array<string>, r array<string>, n array<string>")
    rbo = lambda a, b: d.select(metrics.rank_biased_overlap(F.col(a), F.col(b))).first()[0]
    assert abs(rbo("a", "b") - 1) < 1e-12 and abs(rbo("a", "p") - 1) < 1e-12 and rbo("a", "n") == 0
    full = d.select(metrics.rank_biased_overlap_full(F.col("a"), F.col("r"))).first()[0]
    assert abs(full - rbo("a", "r")) < 1e-12


def test_toy_slates_closed_forms(spark):
    """Perfect answers score 1; copies of what was emitted score .5 * .25 + .3 * .5."""
    modes = ["none", "popular", "price", "stale"]
    rows = [(f"T{k}", m) for k, m in enumerate(modes)]
    perfect = spark.createDataFrame([(i, m, int(m != "none"), m, m == "none", 1.0) for i, m in rows], "id string, truth string, flag int, mode string, same boolean, rbo double")
    copied = spark.createDataFrame([(i, m, 0, "none", True, float(m == "none")) for i, m in rows], "id string, truth string, flag int, mode string, same boolean, rbo double")

    def score(d):
        rep = metrics.bucket_mean(d, "truth", "rbo").first()[0]
        audit = metrics.detection(d, "truth", "flag").first()["balanced"]
        mode = d.filter("truth <> 'none'").groupBy("truth").agg(F.avg((F.col("mode") == F.col("truth")).cast("double")).alias("m")).agg(F.avg("m")).first()[0]
        return (0.5 * rep + 0.3 * audit + 0.2 * mode) * metrics.consistency(d, "flag", "mode", "same").first()["multiplier"]

    assert abs(score(perfect) - 1.0) < 1e-12 and abs(score(copied) - 0.275) < 1e-12


def test_diverse_picks(spark):
    c = spark.createDataFrame([("r", x, s, n) for x, s, n in (("a", 1.0, 5), ("b", 0.95, 5), ("c", 0.5, 9), ("d", 0.5, 9), ("z", -1.0, 9))] + [("few", "a", 1.0, 1)], "r string, i string, score double, support long")
    sim = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.9)], "item_a string, item_b string, cosine double")
    got = ranking.diverse_top_k(c, sim, "r", "i", 3).orderBy("position").collect()
    assert [tuple(x) for x in got] == [("r", 1, "a"), ("r", 2, "c"), ("r", 3, "d")]
    assert ranking.exactly_k(c.filter("r = 'r'"), "i", F.col("score") > 0.4, [F.desc("score")], 3).agg(F.sum("selected")).first()[0] == 3


def test_contracts(spark):
    d = spark.createDataFrame([("a", "1", 1.0, "x"), ("a", "2", float("inf"), "y"), ("b", "2.5", None, "x")], "id string, pos string, v double, w string")
    other = spark.createDataFrame([("a",), ("c",)], "id string")
    c = Contract(d).same_keys(other, ["id"]).unique(["id"]).integer_between("pos", 1, 2).finite("v", 0).constant("w", ["id"]).total("v", 5)
    assert {r[0]: r[1] for r in c.counts().collect()} == {"unknown_key": 1, "missing_key": 1, "duplicate_id": 1, "integer_pos": 1, "finite_v": 2, "constant_w": 1, "total_v": 1}
    with pytest.raises(InvalidData, match="unknown_key: 1 violations"):
        c.require()
    with pytest.raises(InvalidData, match="columns missing"):
        Contract(d).columns(["nope"])
    assert Contract(d).unique(["id", "pos"]).require().count() == 3


SITES = [("NE2", -300), ("IND7", 330), ("NFL1", -210)]


def test_log_round_trip_and_rejects(spark):
    rnd, data = random.Random(1), []
    for i in range(180):
        site, off = SITES[i % 3]
        t = T0 + timedelta(minutes=rnd.choice([0, 5, 719, 725, 1439]) + 1440 * (i % 40))
        data.append((i, f"F{i % 6 + 1}", t, off, ["PMP", "CMP", "FAN", "VLV"][i % 4], i, site, rnd.randrange(-99, 999) / 10 if i % 9 else -0.0, rnd.randrange(800, 9000) / 10, ["OK", "WARN", "FAULT"][i % 3]))
    d = spark.createDataFrame(data, "id int, layout string, utc timestamp, offset int, type string, number int, site string, tc double, pk double, status string")
    lines = transduce.render(d)
    canon = F.concat(F.lit("ts="), F.date_format("utc", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("|dev="), "type", F.lit("-"), F.lpad(F.col("number").cast("string"), 4, "0"), F.lit("|site="), "site", F.lit("|temp_c="), transduce.one_decimal(F.col("tc")), F.lit("|pres_kpa="), F.format_string("%.1f", "pk"), F.lit("|status="), "status")
    lines = lines.withColumn("canonical", canon).select("id", "raw_line", "canonical", F.col("layout").alias("want")).cache()
    sites = spark.createDataFrame(SITES + [("NE2", -300)], "site string, utc_offset_min int")
    got = transduce.transduce(lines, sites)
    assert got.filter("output <> canonical OR layout <> want").count() == 0
    cut = lines.withColumn("raw_line", F.expr("substring(raw_line, 1, length(raw_line) - 6)"))
    assert transduce.transduce(cut, sites).filter("output <> 'REJECT'").count() == 0
    odd = spark.createDataFrame([("<X0001|NE2|20250101000000|t:1.0|p:1.0|s:0>",), ("<P0001|QQ9|20250101000000|t:1.0|p:1.0|s:0>",), ("<P0001|NE2|20251301000000|t:1.0|p:1.0|s:0>",), ("<P0001|NE2|20250101000000|t:1.0|p:1.0|s:7>",), (None,), ("",)], "raw_line string")
    assert [r[0] for r in transduce.transduce(odd, sites).select("output").collect()] == ["REJECT"] * 6
    acc = transduce.field_accuracy(spark.createDataFrame([("ts=a|dev=b|site=c|temp_c=1|pres_kpa=2|status=OK", "ts=a|ts=z|dev=b|site=c|temp_c=1|pres_kpa=2|status=OK"), ("REJECT", "REJECT"), ("REJECT", "ts=a"), ("ts=a|dev=b|site=c|temp_c=1|pres_kpa=2|status=OK", None)], "canonical string, output string"))
    assert [round(r["accuracy"], 6) for r in acc.collect()] == [round(6 / 7, 6), 1.0, 0.0, 0.0]


def test_kneser_ney_against_the_recursion(spark):
    seqs = [("a", list("ABCABBA")), ("b", list("CABA")), ("c", []), ("d", ["A"])]
    d = spark.createDataFrame(seqs, "id string, t array<string>")
    counts = {}
    for _, s in seqs:
        for i, x in enumerate(s):
            for o in range(0, min(2, i) + 1):
                counts.setdefault((o, tuple(s[i - o : i])), {}).setdefault(x, 0)
                counts[(o, tuple(s[i - o : i]))][x] += 1
    toks = sorted({x for (o, _), n in counts.items() if o == 1 for x in n})

    def prob(ctx, o):
        if o == 0:
            return dict.fromkeys(toks, 1 / len(toks))
        low, n = prob(ctx, o - 1), counts.get((o, tuple(ctx[-o:])) if len(ctx) >= o else None)
        if not n:
            return low
        total = sum(n.values())
        dd = min(0.75, total)
        return {t: low[t] * dd * len(n) / total + max(n.get(t, 0) - dd, 0) / total for t in toks}

    ctxs = [("AB", ["A", "B"]), ("BB", ["B", "B"]), ("Z", ["Z"]), ("none", []), ("CA", ["x", "C", "A"])]
    got = sequences.kneser_ney(sequences.ngram_counts(d, "t", 2), spark.createDataFrame(ctxs, "q string, c array<string>"), "q", "c", 2)
    p = {(r["q"], r["token"]): r["p"] for r in got.collect()}
    for q, c in ctxs:
        w = prob(c, min(2, len(c)))
        z = sum(max(v, 1e-9) for v in w.values())
        for t in toks:
            assert abs(p[q, t] - max(w[t], 1e-9) / z) < 1e-12, (q, t)


def test_sequences(spark):
    d = spark.createDataFrame([("b1_s", ["x", "y", "x"]), ("b2_s", []), ("q", ["z", None])], "id string, t array<string>")
    v = sequences.vocabulary(d, "t")
    assert [(r["token"], r["id"]) for r in v.orderBy("id").collect()] == [("<PAD>", 0), ("<UNK>", 1), ("x", 2), ("y", 3), ("z", 4)]
    enc = {r["id"]: r["ids"] for r in sequences.encode(d, "id", "t", v.filter("token <> 'y'")).collect()}
    assert enc == {"b1_s": [2, 1, 2], "b2_s": [], "q": [4, 1]}
    ex = sorted((r["id"], r["position"], r["context"], r["target"]) for r in sequences.prefix_examples(d.filter("id <> 'q'"), "id", "t", 1, 1).collect())
    assert ex == [("b1_s", 1, ["x"], "y"), ("b1_s", 2, ["y"], "x")]
    assert [r[0] for r in d.select(sequences.entity_of(F.col("id"))).collect()] == ["b1", "b2", "q"]


def test_features(spark):
    k = spark.createDataFrame([(0.5, 3.0), (0.1, 1.0), (0.9, 10.0)], "x double, y double")
    d = spark.createDataFrame([(0.0,), (0.3,), (0.7,), (0.95,), (None,)], "p double")
    got = [r["mapped"] for r in features.quantile_map(d, "p", k).collect()]
    assert got[0] == 1.0 and abs(got[1] - 2.0) < 1e-12 and abs(got[2] - 6.5) < 1e-12 and got[3] == 10.0 and got[4] is None
    g = spark.range(1).select(features.gaussian_kernel(F.lit(2.0), F.lit(2.0), 0.5), features.gaussian_kernel(F.lit(0.0), F.lit(2.0), 0.5), features.half_life(F.lit(60.0), 60.0)).first()
    assert tuple(g) == (1.0, 0.0, 0.5)
    f = spark.range(1000).select(features.hash_fold(F.col("id"), 4).alias("f")).groupBy("f").count().collect()
    assert len(f) == 4 and all(200 < r["count"] < 300 for r in f)


def test_sources(spark, tmp_path):
    from shoal.sources import files as S

    (tmp_path / "a.csv").write_text("id,v\n00123,\nnan,x\n")
    (tmp_path / "b.csv").write_text("id,v\n9,z\n")
    (tmp_path / "c.csv").write_text("v,id\n9,z\n")
    a, b, c = (str(tmp_path / f"{x}.csv") for x in "abc")
    assert [tuple(r) for r in S.read_text_columns(spark, a, keep_empty=True).collect()] == [("00123", ""), ("nan", "x")]
    assert S.read_csv(spark, a, "id string, v string", ["v"]).collect()[0][0] is None
    assert S.header(spark, a) == ["id", "v"]
    assert S.read_union(spark, [a, b], ["id", "v"], "id string, v string").count() == 3
    with pytest.raises(S.SourceError):
        S.read_union(spark, [a, c], ["id", "v"], "id string, v string")
    (tmp_path / "x.json").write_text('[{"id": "s1", "symbols": ["A", "B"]}]')
    (tmp_path / "y.json").write_text('{"sequences": [{"id": "s2", "symbols": []}, {"id": "s3", "symbols": null}]}')
    ddl = "id string, symbols array<string>"
    assert [r["id"] for r in S.read_records(spark, str(tmp_path / "x.json"), ddl).collect()] == ["s1"]
    assert [r["id"] for r in S.read_records(spark, str(tmp_path / "y.json"), ddl).collect()] == ["s2", "s3"]
    assert S.first_existing(["/nope", a]) == a
    assert S.as_frame(spark, a, text=True).count() == 2
    assert S.report(spark.createDataFrame([(1, "x")], "a int, b string")) == '{"a": 1, "b": "x"}'
    S.write_table(S.as_frame(spark, a, text=True), str(tmp_path / "t.orc"), kind="orc")
    assert S.as_frame(spark, str(tmp_path / "t.orc")).count() == 2


def test_models(spark):
    from shoal.operators.models import balanced_weights, boosted_scores, boosted_values, out_of_fold, threshold_search

    d = spark.createDataFrame([(i, i % 10, float(i % 7), int(i % 7 > 3)) for i in range(210)] + [(500, 1, None, 0)], "id int, g int, x double, y int")
    w = balanced_weights(d, "y").groupBy("y").agg(F.sum("weight")).collect()
    assert abs(w[0][1] - w[1][1]) < 1e-6
    s = out_of_fold(d, "g", 2, lambda a, b: boosted_scores(a, b, "y", ["x"], rounds=2))
    assert s.count() == d.count() and metrics.auc(s, "score", "y").first()[0] > 0.95
    t = {r["threshold"]: r for r in threshold_search(s, "score", "y", [0.5, 2.0]).collect()}
    assert t[0.5]["f1"] > 0.95 and t[2.0]["f1"] == 0 and t[2.0]["precision"] == 0
    assert boosted_values(d.limit(0), d, "y", ["x"]).filter("score IS NOT NULL").count() == 0
