"""Co-occurrence, leaks, mixing and reading level against brute force and closed forms."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from shoal.llm import leaks
from shoal.llm.cooccur import item_pairs
from shoal.llm.leaks import leaked_items, near_items, words_of
from shoal.llm.mixing import actual_shares, draw_mixture, plan_mixture, token_counts, water_fill
from shoal.llm.reading import Lexicon, Trees, features, fit_reading_model, isotonic, letter_models, reading_levels, word_spread


def test_pairs_against_brute_force(spark, monkeypatch):
    import shoal.llm.cooccur as C

    monkeypatch.setattr(C, "HOLD", 40)
    rnd = random.Random(1)
    data = [(f"b{i}", rnd.choice("abcdefgh")) for i in range(80) for _ in range(rnd.randrange(0, 6))]
    # a third of all rows is one basket, and rows repeat
    data += [("big", x) for x in "abcdefgh" for _ in range(12)] + [(None, "a"), ("b1", None)] + data[:20]
    got = {(r["item_a"], r["item_b"]): r for r in item_pairs(spark.createDataFrame(data, "basket string, item string"), "basket", "item", 3).collect()}
    sets = {}
    for b, i in data:
        if b is not None and i is not None:
            sets.setdefault(b, set()).add(i)
    n, one, two = len(sets), Counter(i for s in sets.values() for i in s), Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    assert set(got) == {p for p, k in two.items() if k >= 3}
    for (a, b), r in got.items():
        k, na, nb = two[a, b], one[a], one[b]
        assert (r["n_ab"], r["n_a"], r["n_b"], r["n"]) == (k, na, nb, n)
        cells = [(k, na * nb / n), (na - k, na * (n - nb) / n), (nb - k, (n - na) * nb / n), (n - na - nb + k, (n - na) * (n - nb) / n)]
        llr = 2 * sum(o * math.log(o / e) for o, e in cells if o > 0)
        assert abs(abs(r["llr"]) - llr) < 1e-6 and (llr < 1e-9 or (r["llr"] > 0) == (r["lift"] >= 1))
    tight = item_pairs(spark.createDataFrame(data, "basket string, item string"), "basket", "item", 1, 0.05, 1.2).collect()
    assert {(r["item_a"], r["item_b"]) for r in tight} == {(a, b) for (a, b), k in two.items() if k >= 0.05 * n and k * n >= 1.2 * one[a] * one[b]}
    assert item_pairs(spark.createDataFrame([], "basket string, item string"), "basket", "item").count() == 0


def test_leaks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leaks, "HOLD", 900)
    monkeypatch.setattr(leaks, "LONG", 20)
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(30)] + ["The", "the", "Été", "x1"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(f"q{i}", text(rnd.randrange(3, 25))) for i in range(9)] + [("short", "w1 w2"), ("none", None), (None, text(20)), ("rare", " ".join(f"only{i}" for i in range(14)))]
    docs = []
    for i in range(60):
        t = text(rnd.randrange(0, 40))
        if rnd.random() < 0.5:
            w = (rnd.choice(items[:9])[1] or "").split()
            k = rnd.randrange(0, max(1, len(w) - 5))
            t += " -- " + ", ".join(w[k : k + rnd.randrange(4, 14)]).upper() + "; " + text(3)
        docs.append((i, t, "clash"))
    docs += [(100, None, ""), (101, "", ""), (102, "...", ""), (103, "w1 " * 300_000 + items[0][1], ""), (104, docs[0][1], "")]
    for words in (3, 5):
        grams = lambda ws: {tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)}
        want = {(d, q) for d, t, _ in docs for q, it in items if q is not None and grams(words_of(t)) & grams(words_of(it))}
        got = leaked_items(spark.createDataFrame(docs, "doc_id long, text string, item_id string").drop("item_id"), spark.createDataFrame(items, "item_id string, text string"), words=words)
        assert {tuple(r) for r in got.collect()} == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert leaked_items(empty, spark.createDataFrame(items, "item_id string, text string")).count() == 0
    assert leaked_items(spark.createDataFrame(docs[:2], "doc_id long, text string, z string"), spark.createDataFrame([], "item_id string, text string")).count() == 0


def test_near_items(spark):
    item = [("q", "alpha beta gamma delta epsilon zeta common common")]
    docs = [(1, "zeta x epsilon y delta gamma beta alpha"), (2, "alpha beta gamma delta epsilon " + "common " * 80 + "zeta"), (3, "alpha beta")]
    got = near_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item, "item_id string, text string"), rare=6, span=20)
    assert [tuple(r) for r in got.collect()] == [(1, "q", 8)]


def test_water_filling():
    w = water_fill({"a": 100, "b": 10, "c": 1000, "x": 5}, {"a": 0.3, "b": 0.3, "c": 0.3, "gone": 0.1}, {"a": 2, "b": 3, "c": 1, "gone": 4}, 600)
    # b is held at 30, its excess goes to a and c alike; a then is held at 200, c takes the rest
    assert w == {"a": 200.0, "b": 30.0, "c": 370.0, "gone": 0.0}
    assert water_fill({"a": 10}, {"a": 1.0}, {"a": 2}, 100) == {"a": 20.0}
    assert water_fill({}, {"a": 1.0}, {"a": 2}) == {"a": 0.0}
    rnd = random.Random(1)
    for _ in range(50):
        names = "abcde"
        size = {s: rnd.randrange(0, 50) for s in names}
        cap = {s: rnd.randrange(0, 4) for s in names}
        share = {s: rnd.random() for s in names}
        total = rnd.randrange(1, 200)
        w = water_fill(size, share, cap, total)
        usable = [s for s in names if size[s] * cap[s] > 0]
        assert all(w[s] <= size[s] * cap[s] + 1e-9 for s in names)
        assert abs(sum(w.values()) - min(total, sum(size[s] * cap[s] for s in usable))) < 1e-6
        free = [s for s in usable if w[s] < size[s] * cap[s] - 1e-9]
        ratios = [w[s] / share[s] for s in free]
        assert not ratios or max(ratios) - min(ratios) < 1e-6


def test_draw_is_exact_seeded_and_capped(spark):
    rnd = random.Random(5)
    data = [(i, rnd.choice(["big"] * 6 + ["small", None, "other"]), rnd.choice([0, 1, 5, 40])) for i in range(4000)]
    sized = spark.createDataFrame(data, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.45, 3), ("void", 0.05, 2), ("small", 0.45, 3)], "source string, target_share double, max_repeats int")
    plan = plan_mixture(sized, targets)
    drawn = draw_mixture(sized, plan, "doc_id")
    rows = {r["doc_id"]: r for r in drawn.collect()}
    p = {r["source"]: r for r in plan.collect()}
    for s in ("big", "small"):
        got = sum(r["tokens"] * r["copies"] for r in rows.values() if r["source"] == s)
        assert abs(got - p[s]["allotted"]) <= 40
        assert max(r["copies"] for r in rows.values() if r["source"] == s) <= p[s]["max_repeats"]
        assert {r["copies"] for r in rows.values() if r["source"] == s} <= {p[s]["whole"], p[s]["whole"] + 1}
    assert not [r for r in rows.values() if r["tokens"] == 0 or r["source"] not in ("big", "small")]
    again = {r["doc_id"]: r["copies"] for r in draw_mixture(sized.repartition(7), plan, "doc_id").collect()}
    assert again == {k: r["copies"] for k, r in rows.items()}
    shares = {r["source"]: r for r in actual_shares(drawn, plan).collect()}
    assert abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9 and shares["void"]["drawn"] == 0 and shares["small"]["capped"]
    assert draw_mixture(sized.limit(0), plan_mixture(sized.limit(0), targets), "doc_id").count() == 0


def test_tokens(spark):
    import base64
    from pathlib import Path

    import tiktoken

    from shoal.llm.mixing import SPLIT, TOKENIZERS

    path = Path(TOKENIZERS) / "byte_bpe_50k.tiktoken"
    if not path.exists():
        pytest.skip("no tokenizer files")
    texts = ["A pump failed at 05:15.", "", None, "  spaces\n\n and <|endoftext|>", "Ünïcode ✓", "word " * 50_000]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.open("rb"))}
    enc = tiktoken.Encoding("t", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    got = token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r["tokens"] for r in got] == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)


def test_trees_and_isotonic():
    g = np.random.default_rng(0)
    x = g.uniform(0, 1, (600, 4))
    y = np.where(x[:, 0] > 0.5, 3.0, 1.0) + np.where(x[:, 1] > 0.3, 1.0, 0.0) * (x[:, 0] > 0.5)
    t = Trees().fit(x[:400], y[:400])
    assert np.abs(t.predict(x[400:]) - y[400:]).mean() < 0.1
    a, b = isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 5]))
    assert np.allclose(np.interp([1, 2, 2.5, 3, 4], a, b), [1, 2.5, 2.5, 2.5, 5]) and (np.diff(b) >= 0).all()


EASY = ["the pump ran well", "it was hot by noon", "we saw the red cart", "no one fixed the tool"]
HARD = ["the multidimensional discontinuity of the autocorrelation presupposes an asymptotically negligible generalisation", "notwithstanding the commensurability of the specification, its recalibration differentiates the instrumentation"]


def doc(rnd, hard, n=12):
    return ". ".join(rnd.choice(HARD if hard else EASY).capitalize() for _ in range(n)) + "."


def test_reading_levels(spark):
    rnd = random.Random(3)
    docs = [(i, doc(rnd, i % 2), f"s{i % 3}" if i % 5 else None) for i in range(120)]
    docs += [(900, None, "s1"), (901, "", "s1"), (902, "cart", "s1"), (903, "Nadie sabe por qué la bomba estaba vacía y la llave en el taller", "s1"), (904, "HN-184;21;64.8\nQZ-114;15;44.24\n" * 9, "s1")]
    docs += [(905, "Idiosyncratic redundancy. Systematic interdependence; recalibration pending. Heterogeneous uncertainty unresolved. Multidimensional generalisation.", None)]
    docs += [(906, doc(rnd, True) * 400, "s2")]
    labels = [(i, 5 if i % 2 else 1, "a") for i in range(0, 100)] + [(0, 2, "b"), (900, 3, "a"), (None, 1, "a"), (5000, 2, "a"), (3, None, "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    model = fit_reading_model(d, spark.createDataFrame(labels, "doc_id long, band int, labeller string"))
    assert set(model.folds["source"].fillna("-")) == {"s0", "s1", "s2", "-"}
    got = {r["doc_id"]: r["band"] for r in reading_levels(d, model).collect()}
    assert len(got) == len(docs)
    assert all(got[i] == (5 if i % 2 else 1) for i in range(100, 120)) and got[906] == 5
    assert [got[i] for i in (900, 901, 902, 903, 904)] == [None] * 5
    assert got[905] is not None
    assert fit_reading_model(d, spark.createDataFrame(labels[:3], "doc_id long, band int, labeller string")) is None
    assert reading_levels(d.limit(0), model).count() == 0


def test_letter_models_tell_languages(spark):
    said = {
        "en": ["the pump was out of order and we had to fetch another one from the store", "nobody knew why the valve had been left open over night"],
        "de": ["die pumpe war nicht im lager und wir haben sie nicht gefunden", "niemand wusste warum das ventil über nacht offen war"],
        "fr": ["la pompe est restée dans le local pour les équipes de nuit", "personne ne savait pourquoi la vanne était ouverte"],
    }
    rows = [(10 * i + k, t, " " + lang.upper() + "-x") for i, (lang, ts) in enumerate(said.items()) for k, t in enumerate(ts)] + [(90, None, "en"), (91, "die pumpe", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lex = Lexicon(word_spread(docs), letter_models(docs, docs.filter("doc_id = 0").select("doc_id")))
    new = ["the store had the other valve and the pump was left out there", "wir wussten nicht warum die pumpe im lager nicht offen war", "la vanne est ouverte pour les équipes dans le local", "QZ-1 HN-2 KV-3 XX-4 ZQ-5 NH-6 VK-7 WX-8", "too short", "", None]
    x, reason = features(new, lex)
    assert list(reason) == ["", "not English", "not English", "not English", "too short", "no text", "no text"]
    assert np.isfinite(x).all() and (features(["a b " * 200_000], lex)[0][0, 0] == np.log(400_000))


def test_features_by_hand(spark):
    docs = spark.createDataFrame([(1, "aa bb. cc dd ee aa"), (2, "aa")], "doc_id long, text string")
    lex = Lexicon(word_spread(docs), np.ones((1, 1 << 15)))
    x = dict(zip(["log_words", "words_per_sentence", "sentence_p25", "sentence_p50"], features(["aa bb. cc dd ee aa, aa bb cc! dd"], lex)[0][0]))
    assert x == {"log_words": np.log(10), "words_per_sentence": 10 / 3, "sentence_p25": 1.0, "sentence_p50": 2.0}
    # aa is in both documents, bb in one
    assert lex.facts("aa")[2] == 0.0 and abs(lex.facts("bb")[2] - np.log(1.5 / 2.5)) < 1e-6


def test_large_baskets_are_cut(spark, monkeypatch):
    import shoal.llm.cooccur as C

    monkeypatch.setattr(C, "ANCHORS", 7)
    monkeypatch.setattr(C, "HOLD", 30)
    rows = [("big", f"i{k:02}") for k in range(40)] + [("b", "i00"), ("b", "i39"), ("c", "i00")]
    got = {(r["item_a"], r["item_b"]): r["n_ab"] for r in item_pairs(spark.createDataFrame(rows, "b string, i string"), "b", "i").collect()}
    assert len(got) == 40 * 39 // 2 and got["i00", "i39"] == 2 and got["i01", "i02"] == 1
    # significance is a bound of its own: i00 is on all baskets, so nothing about it is beyond chance
    assert all("i00" not in (r["item_a"], r["item_b"]) for r in item_pairs(spark.createDataFrame(rows, "b string, i string"), "b", "i", min_llr=C.LLR_5).collect())


def test_one_index_for_many_items(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x y a b c d"), (3, None), (None, "a b c d")], "doc_id long, text string")
    index = leaks.build_index(docs)
    assert index.filter("term IS NULL").selectExpr("explode(ids)").count() == 2
    for text, want in (("q c d e q", {1}), ("A, B; C-D", {1, 2}), ("b c x d", set()), ("nowhere b c d", {1, 2})):
        items = spark.createDataFrame([("q", text)], "item_id string, text string")
        assert {r["doc_id"] for r in leaked_items(docs, items, words=3, index=index).collect()} == want
    near = near_items(docs, spark.createDataFrame([("q", "d x missing")], "item_id string, text string"), need=2, span=10, index=index)
    assert [tuple(r) for r in near.collect()] == [(2, "q", 6)]


def test_letter_models_count_every_document_and_language(spark):
    rnd = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèêçñåøæœабвгдежзиклмнопрстуф"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 6)))
    langs = ["en"] * 30 + ["de"] * 12 + [a + "x" for a in "abcdefghijklmno"]
    rows = [(i, f"{word()} {word()}.", rnd.choice(langs)) for i in range(1500)] + [(5000, "zq zq", None), (5001, None, "de"), (5002, "xx yy", " FR-fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    count, met = {}, Counter()
    size = 1 << 15
    for i, t, lang in rows:
        for code in {"en"} if i == 5000 else {lang.strip().lower()[:2], "en"} if i < 10 else {lang.strip().lower()[:2]}:
            c = count.setdefault(code, np.zeros(size))
            for w in (t or "").strip(".").split():
                s = f" {w} "
                met.update(s[:-1])
                for k in range(len(s) - 2):
                    c[zlib.crc32(s[k : k + 3].encode()) & (size - 1)] += 1
    p = {ch: k / sum(met.values()) for ch, k in met.items()}
    assert len(p) > 55 and len(count) > 15 and max(Counter(lang for _, _, lang in rows).values()) > 400
    by_chance = np.full(size, 1e-9)
    for a, b, c in itertools.product(p, repeat=3):
        by_chance[zlib.crc32(f"{a}{b}{c}".encode()) & (size - 1)] += p[a] * p[b] * p[c]
    want = np.array([np.log(0.8 * count[x] / max(count[x].sum(), 1) / by_chance + 0.2) for x in ["en", *sorted(set(count) - {"en"})]])
    got = letter_models(docs.repartition(5), docs.filter("doc_id < 10 OR doc_id = 5000").select("doc_id"))
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-6)


def test_every_label_is_fitted(spark):
    rnd = random.Random(6)
    docs = spark.createDataFrame([(i, doc(rnd, i % 2, 3), f"s{i % 4}") for i in range(4100)], "doc_id long, text string, source string")
    model = fit_reading_model(docs, spark.createDataFrame([(i, 5 if i % 2 else 1) for i in range(4100)], "doc_id long, band int"))
    assert sorted(model.folds["doc_id"]) == list(range(4100))
