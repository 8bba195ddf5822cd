"""Candidates, digests, checkpoints of vocabularies, learned log rules and entity models on small fixtures."""

import pytest

from shoal.operators import sequences, transduce
from shoal.operators.contracts import Contract
from shoal.operators.joins import co_occurrence
from shoal.operators.metrics import candidate_recall, catalog_coverage
from shoal.sources.files import SourceError, file_digests, load_vocabulary, require_digests, save_vocabulary


def test_candidate_recall_and_coverage(spark):
    c = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 9), (None, 3), ("a", None)], "u string, i int")
    t = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("z", 1), (None, 1)], "u string, i int")
    got = {r["u"]: tuple(r)[1:] for r in candidate_recall(c, t, "u", "i").collect()}
    assert got == {"a": (2, 1, 2, 0.5), "z": (1, 0, 0, 0.0)}
    assert candidate_recall(c, t.limit(0), "u", "i").count() == 0
    catalog = spark.createDataFrame([(1,), (2,), (2,), (4,), (None,)], "i int")
    assert tuple(catalog_coverage(c, catalog, "i").first()) == (3, 2, 2 / 3)
    assert catalog_coverage(c, catalog.limit(0), "i").first()["coverage"] is None


def test_digests_and_vocabulary_checkpoint(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"pump")
    (tmp_path / "in" / "b.txt").write_bytes(b"fan\n" * 1000)
    want = {n: hashlib.sha256(b).hexdigest() for n, b in (("a.txt", b"pump"), ("b.txt", b"fan\n" * 1000))}
    at = str(tmp_path / "in")
    assert {r["file"]: r["sha256"] for r in file_digests(spark, at).collect()} == want
    require_digests(spark, at, want)
    for wrong in ({"a.txt": want["a.txt"]}, {**want, "c.txt": "0"}, {**want, "a.txt": want["b.txt"]}):
        with pytest.raises(SourceError):
            require_digests(spark, at, wrong)
    v = sequences.vocabulary(spark.createDataFrame([(["x", "y", "x"],)], "t array<string>"), "t")
    save_vocabulary(v, str(tmp_path / "v"), order=5, name="m")
    got, settings = load_vocabulary(spark, str(tmp_path / "v"))
    assert settings == {"order": 5, "name": "m"} and {r["token"]: r["id"] for r in got.collect()} == {"<PAD>": 0, "<UNK>": 1, "x": 2, "y": 3}


def test_first_failure(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1.0) for i in range(20)], "id int, x double")
    got = Contract(df).unique(["id"]).finite("x").integer_between("id", 0, 3).first_failure().collect()
    assert [tuple(r) for r in got] == [("finite_x", 10, ["null"] * 5)]
    assert Contract(df).unique(["id"]).first_failure().count() == 0


def test_rules_are_learned_from_pairs(spark):
    from pyspark.sql import functions as F

    sites = spark.createDataFrame([("NE2", -300), ("IND7", 330)], "site string, utc_offset_min int")
    rows = [
        (f"F{k % 6 + 1}", f"2025-{1 + k % 12:02}-{1 + k % 28:02} 07:{k % 60:02}:00", (-300, 330)[k // 6 % 2], ("NE2", "IND7")[k // 6 % 2], ("PMP", "CMP", "FAN", "VLV")[k // 12 % 4], k, k / 2 - 20, 90.0 + k, ("OK", "WARN", "FAULT")[k // 48 % 3])
        for k in range(288)
    ]
    d = spark.createDataFrame(rows, "layout string, u string, offset int, site string, type string, number int, tc double, pk double, status string").withColumn("utc", F.to_timestamp("u"))
    dev = F.concat("type", F.lit("-"), F.lpad(F.col("number").cast("string"), 4, "0"))
    canon = F.concat(F.lit("ts="), F.date_format("utc", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("|dev="), dev, F.lit("|site="), "site", F.lit("|temp_c="), transduce.one_decimal(F.col("tc")), F.lit("|pres_kpa="), F.format_string("%.1f", "pk"), F.lit("|status="), "status")
    pairs = transduce.render(d).withColumn("canonical", canon).select("raw_line", "canonical")
    rules, offsets = transduce.learn_rules(pairs)
    known = transduce.published()
    assert rules.types == known.types and rules.status == known.status and rules.day_first == known.day_first
    assert {k: v for k, v in rules.numbers.items() if v != "as printed"} == known.numbers
    assert {r["site"]: r["utc_offset_min"] for r in offsets.collect()} == {r["site"]: r["utc_offset_min"] for r in sites.collect()}
    exact = transduce.exact_matches(transduce.transduce(pairs, offsets, rules)).collect()
    assert len(exact) == 6 and all(r["exact"] == 1.0 and r["n"] == 48 for r in exact)


def test_entity_models_do_not_mix(spark):
    d = spark.createDataFrame([("a", list("XYXYXY")), ("b", list("XZXZXZ"))], "e string, t array<string>")
    n = sequences.ngram_counts(d, "t", 3, by=["e"])
    q = spark.createDataFrame([("a", "k", ["X"]), ("b", "k", ["X"]), ("none", "k", ["X"])], "e string, q string, c array<string>")
    got = {(r["e"], r["token"]): r["p"] for r in sequences.kneser_ney(n, q, "q", "c", 3, by=["e"]).collect()}
    assert set(got) == {("a", "X"), ("a", "Y"), ("b", "X"), ("b", "Z")}
    assert got["a", "Y"] > 0.8 and got["b", "Z"] > 0.8 and abs(got["a", "X"] + got["a", "Y"] - 1) < 1e-12


def test_one_basket_with_most_rows(spark):
    rows = [("big", f"i{k:03}") for k in range(120)] * 2 + [("small", "i000"), ("small", "i001"), (None, "i0"), ("x", None)]
    got = co_occurrence(spark.createDataFrame(rows, "b string, i string"), "b", "i", hold=50)
    n = {(r["item_a"], r["item_b"]): r["n_ab"] for r in got.collect()}
    assert len(n) == 120 * 119 and n["i000", "i001"] == 2 and n["i001", "i000"] == 2 and n["i005", "i004"] == 1
