"""Queries that must cover their whole table, against brute force on small fixtures."""

import datetime
import itertools
import random
from collections import defaultdict
from math import log1p, sqrt

import pandas as pd

import __spark_entry__ as entry
from shoal.operators.ranking import best_similar, diverse_by_history


def sales(tmp_path, seed=3, invoices=60, items=12, customers=9):
    """Written sf_transactions, and their (invoice, customer, day, item) of sales."""
    rnd, rows = random.Random(seed), []
    for i in range(invoices):
        who, day = rnd.choice([f"C{k}" for k in range(customers)] + [None]), datetime.datetime(2024, 1, 1) + datetime.timedelta(days=rnd.randrange(90))
        for k in rnd.sample(range(items), rnd.randrange(1, 5)):
            rows.append((f"v{i}", f" i{k:03} " if rnd.random() < 0.2 else f"I{k:03}", rnd.choice([1, 2, 3, -1]), day, who))
    df = pd.DataFrame(rows, columns=["invoice", "stock_code", "quantity", "invoice_date", "customer_id"])
    df["invoice_date"] = df["invoice_date"].astype("datetime64[us]")
    df.to_parquet(tmp_path / "sf_transactions.parquet")
    return [(i, w, t, c.strip().upper()) for i, c, q, t, w in rows if q > 0]


def pair_counts(lines):
    baskets = defaultdict(set)
    for i, _, _, x in lines:
        baskets[i].add(x)
    n, both = defaultdict(int), defaultdict(int)
    for b in baskets.values():
        for x in b:
            n[x] += 1
        for x, y in itertools.permutations(b, 2):
            both[x, y] += 1
    return n, both


def test_similar_items_score_of_every_customer(spark, tmp_path):
    lines = sales(tmp_path)
    n, both = pair_counts(lines)
    want = defaultdict(float)
    for w, x in {(w, x) for _, w, _, x in lines if w}:
        for (a, b), k in both.items():
            if a == x:
                want[w, b] = max(want[w, b], k / sqrt((n[a] + 5) * (n[b] + 5)))
    got = {(r["customer_id"], r["item"]): r["best"] for r in entry.queries()["similar_items_score"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len({w for w, _ in got}) == 9
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_similar_items_are_not_joined(spark, tmp_path):
    # a join of owned items and pairs has a row for each item similar to each owned one: 1.7 billion over a million sales
    sales(tmp_path)
    plan = entry.queries()["similar_items_score"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_best_similar_in_blocks_and_buckets(spark):
    rnd = random.Random(4)
    owned = [(rnd.choice("uvw") * rnd.randrange(1, 9), rnd.randrange(40)) for _ in range(300)] + [("lone", 99), ("lone", None), (None, 3)]
    sparse = {(a, b): rnd.random() for a in range(40) for b in range(60) if rnd.random() < 0.1}
    dense = {(a, b): 0.0 if b == 7 else rnd.random() for a in range(40) for b in range(60) if a != b}
    o = spark.createDataFrame(owned, "who string, i long")
    for pairs in (sparse, dense, {}):
        similar = spark.createDataFrame([(a, b, v) for (a, b), v in pairs.items()], "item_a long, item_b long, v double")
        want = defaultdict(lambda: -1.0)
        for w, x in owned:
            for (a, b), v in pairs.items():
                if w and a == x:
                    want[w, b] = max(want[w, b], v)
        for held in (50, 10_000):
            got = best_similar(o, similar, "who", "i", "v", held=held).collect()
            assert len(got) == len(want) and {(r["who"], r["i"]): r["v"] for r in got} == want


def test_diverse_slates_out_of_all_items(spark, tmp_path):
    lines = [x for x in sales(tmp_path, seed=5, invoices=1500, items=180, customers=4) if x[1]]
    n, both = pair_counts(lines)
    cos = {(a, b): k / sqrt(n[a] * n[b]) for (a, b), k in both.items()}
    assert min(cos.values()) < 0.05
    anchor, want = max(t for _, _, t, _ in lines), {}
    for who in {w for _, w, _, _ in lines}:
        last = {}
        for _, w, t, x in lines:
            if w == who:
                last[x] = max(last.get(x, t), t)
        hist = sorted(((0.5 ** ((anchor - t).days / 60), x) for x, t in last.items()), key=lambda h: (-h[0], h[1]))[:40]
        score = {y: round(sum(w * cos.get((x, y), 0) for w, x in hist) * (1 + 0.1 * log1p(n[y])), 9) for y in n if y not in {x for _, x in hist}}
        pool = {y: s for y, s in score.items() if s > 0}
        picks = []
        for _ in range(10):
            picks.append(min((y for y in pool if y not in picks), key=lambda y: (-(pool[y] - 0.9 * max([cos.get((p, y), 0) for p in picks], default=0)), -n[y], y)))
        want[who] = picks
    got = entry.queries()["diverse_slates"](spark, str(tmp_path)).orderBy("customer_id", "position").collect()
    assert {w: [r["item"] for r in got if r["customer_id"] == w] for w in want} == want and len(got) == 40


def test_diverse_picks_beyond_a_short_list(spark):
    # a twin of each of 120 well-scored items is close to the first pick; the last item is close to none
    pairs = [("h", f"a{i:03}", 1.0) for i in range(120)] + [("h", "z", 0.5)] + [(f"a{i:03}", f"a{j:03}", 0.9) for i in range(120) for j in range(i)]
    both = [(x, y, 5, c) for a, b, c in pairs for x, y in ((a, b), (b, a))]
    similar = spark.createDataFrame(both, "item_a string, item_b string, n_a long, cosine double")
    history = spark.createDataFrame([("r", "h", 1.0), ("few", "z", 1.0)], "r string, i string, w double")
    got = [tuple(x) for x in diverse_by_history(history, similar, "r", "i", 2, tilt=0.0).orderBy("position").collect()]
    assert got == [("r", 1, "a000"), ("r", 2, "z")]


def test_default_lists_of_every_customer(spark, tmp_path):
    pd.DataFrame({"c_custkey": range(1, 8), "c_nationkey": [3, 5, 0, 24, 3, 7, 5]}).to_parquet(tmp_path / "customer.parquet")
    lines = [(o, p) for p in range(1, 13) for o in range(p)] + [(0, 1)] * 20
    pd.DataFrame(lines, columns=["l_orderkey", "l_partkey"]).to_parquet(tmp_path / "lineitem.parquet")
    got = {tuple(r) for r in entry.queries()["popular_baseline"](spark, str(tmp_path)).select("c_custkey", "rank", "l_partkey").collect()}
    assert got == {(c, r, 13 - r) for c in range(1, 8) for r in range(1, 11)}
    got = [tuple(r) for r in entry.queries()["users_by_ranks"](spark, str(tmp_path)).select("c_custkey", "rank").collect()]
    assert sorted(got) == [(c, r) for c in range(1, 8) for r in (1, 2, 3)]


def test_copurchase_cosine_of_every_pair(spark, tmp_path):
    n, both = pair_counts(sales(tmp_path, seed=7, invoices=40))
    assert min(both.values()) == 1 and max(both.values()) > 2
    got = {(r["item_a"], r["item_b"]): r for r in entry.queries()["copurchase_cosine"](spark, str(tmp_path)).collect()}
    assert {p: r["n_ab"] for p, r in got.items()} == both
    assert all(abs(r["cosine"] - both[a, b] / sqrt(n[a] * n[b])) < 1e-6 and abs(r["smoothed"] - both[a, b] / sqrt((n[a] + 5) * (n[b] + 5))) < 1e-6 for (a, b), r in got.items())


def test_next_symbol_of_every_user(spark, tmp_path):
    rnd, rows = random.Random(9), []
    for u in range(1, 12):
        for k in range(1 if u == 1 else rnd.randrange(2, 9)):
            rows.append((len(rows), u, rnd.choice(["view", "click", "error", "purchase"]), datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k)))
    df = pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "ts"])
    df["ts"] = df["ts"].astype("datetime64[us]")
    df.to_parquet(tmp_path / "events.parquet")
    seqs = {u: [e for _, w, e, _ in rows if w == u] for u in range(1, 12)}
    follow = defaultdict(lambda: defaultdict(int))
    for s in seqs.values():
        for o in (1, 2):
            for i in range(o, len(s)):
                follow[tuple(s[i - o : i])][s[i]] += 1
    tokens = sorted({t for c, f in follow.items() if len(c) == 1 for t in f})

    def model(ctx):
        p = dict.fromkeys(tokens, 1 / len(tokens))
        for o in (1, 2):
            f = follow.get(tuple(ctx[-o:])) if len(ctx) >= o else None
            if f:
                n = sum(f.values())
                p = {t: p[t] * 0.75 * len(f) / n + max(f.get(t, 0) - 0.75, 0) / n for t in tokens}
        return p

    want = {u: min(tokens, key=lambda t: (-round(model(s[-2:])[t], 8), t)) for u, s in seqs.items()}
    got = entry.queries()["next_symbol"](spark, str(tmp_path)).collect()
    assert {r["user_id"]: r["token"] for r in got if r["user_id"] is not None} == want
    assert {"view>click", "error>error", "purchase>nothing"} <= {r["q"] for r in got}
    p = {(r["q"], r["token"]): r["p"] for r in entry.queries()["kneser_ney"](spark, str(tmp_path)).collect()}
    assert all(abs(p[">".join(s[-2:]), t] - model(s[-2:])[t]) < 1e-7 for s in seqs.values() for t in tokens)
