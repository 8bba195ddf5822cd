"""What the plans must and must not contain, and results that don't depend on partitioning."""

import os
import random

import pytest

import __spark_entry__ as entry
from shoal.operators import metrics
from shoal.operators.joins import co_occurrence
from shoal.operators.scans import global_numbers

DATA = os.environ.get("SHOAL_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    p = plan(entry.queries()["pruned_scan"](spark, DATA))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(l_quantity,45.0)" in p and "EqualTo(l_returnflag,R)" in p
    assert "l_extendedprice" not in p and "l_comment" not in p


@needs_data
@pytest.mark.parametrize("name", ["valid_sales", "orders_enriched", "failure_within_48h", "readings_outside_downtime", "copurchase_cosine", "ndcg_at_20", "auc_by_type", "rolling_statistics", "last_failure_as_of", "p2_found", "p3_found"])
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(entry.queries()[name](spark, DATA))


@needs_data
def test_top_k_limits_groups_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["neighbours_top5"](spark, DATA))


def test_numbers_and_scores_do_not_depend_on_partitions(spark):
    rnd = random.Random(1)
    data = [(rnd.choice("abcde") * rnd.randrange(1, 4), i, rnd.random() < 0.3, round(rnd.random(), 2)) for i in range(500)]
    base = spark.createDataFrame([(a, i, int(y), s) for a, i, y, s in data], "w string, i int, y int, s double")
    want = {i: n for n, (_, i) in enumerate(sorted((a, i) for a, i, _, _ in data))}
    for n in (1, 7):
        d = base.repartition(n)
        assert {r["i"]: r["n"] for r in global_numbers(d, ["w", "i"]).collect()} == want
        assert round(metrics.average_precision(d, "s", "y").first()[0], 12) == round(metrics.average_precision(base, "s", "y").first()[0], 12)


def test_pairs_of_a_hot_basket(spark):
    data = [("hot", f"i{k}") for k in range(40) for _ in range(5)] + [("b", "i1"), ("b", "i2"), (None, "i3"), ("c", None)]
    got = {(r["item_a"], r["item_b"]): r["n_ab"] for r in co_occurrence(spark.createDataFrame(data, "b string, i string"), "b", "i", hold=100).collect()}
    assert len(got) == 40 * 39 and got["i1", "i2"] == 2 and got["i2", "i1"] == 2 and got["i1", "i3"] == 1
