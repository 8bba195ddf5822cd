"""p4_pairs must hold every pair of codes on a common invoice."""

import itertools
from collections import Counter

import pandas as pd

import __spark_entry__ as entry
from shoal.llm.cooccur import item_pairs


def test_pairs_on_few_invoices(spark, tmp_path):
    baskets = {f"v{i}": ["10000", "10001"] + (["10002", "10003a"] if i < 1 else ["10002"] if i < 3 else []) for i in range(6)}
    rows = [(i, f" {c}", 1) for i, b in baskets.items() for c in b] + [("C1", "10003A", 1), ("C1", "10001", 1), ("v9", "POST", 1), ("v9", "10000", 1), ("v8", "10000", -1), ("v8", "10003A", 1)]
    pd.DataFrame(rows, columns=["invoice", "stock_code", "quantity"]).to_parquet(tmp_path / "sf_transactions.parquet")
    want = Counter(p for b in baskets.values() for p in itertools.combinations(sorted(c.upper() for c in b), 2))
    got = entry.queries()["p4_pairs"](spark, str(tmp_path)).collect()
    assert {(r["code_a"], r["code_b"]): r["n_ab"] for r in got} == want
    # 8 invoices count; 10002 is on 3 of them, 10003A on 2
    assert {(r["n_ab"], r["n_a"], r["n_b"], r["lift"]) for r in got if r["code_a"] == "10002"} == {(1, 3, 2, round(8 / 6, 6))}
    pairs = item_pairs(spark.createDataFrame([("x", "a"), ("x", "b")], "basket string, item string"), "basket", "item")
    assert pairs.count() == 1
