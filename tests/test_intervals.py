"""Merged periods and gaps against brute force, whatever the partitioning."""

import random

import pytest

from shoal.operators.intervals import merge_intervals


def brute(data):
    by = {}
    for e, s, t in data:
        if e is not None and s is not None and t is not None and t > s:
            by.setdefault(e, []).append((s, t))
    out = []
    for e, iv in by.items():
        merged = []
        for s, t in sorted(iv):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        out += [(e, "down", s, t) for s, t in merged]
        out += [(e, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    names = ["a"] * 6 + ["b", "c", "d", None]
    data = []
    for _ in range(300):
        s = rnd.randrange(0, 4000)
        data.append((rnd.choice(names), s if rnd.random() > 0.02 else None, s + rnd.choice([0, -5, 1, 5, 12, 900 if seed % 2 else 3])))
    spark.conf.set("spark.sql.shuffle.partitions", str(1 + 5 * seed))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = merge_intervals(
            spark.createDataFrame([(*d, 1) for d in data], "e string, start_s long, end_s long, entity int"), "e", "start_s", "end_s"
        )
        assert sorted(tuple(r) for r in got.select("e", "kind", "start_s", "end_s").collect()) == brute(data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_touching_nested_repeated_and_empty(spark):
    data = [("p", 0, 10), ("p", 10, 20), ("p", 2, 5), ("p", 0, 10), ("p", 30, 31), ("q", 5, 5), (None, 0, 9)]
    df = spark.createDataFrame(data, "e string, s long, t long")
    assert sorted(tuple(r) for r in merge_intervals(df, "e", "s", "t").collect()) == [("p", "down", 0, 20), ("p", "down", 30, 31), ("p", "gap", 20, 30)]
    assert merge_intervals(df.limit(0), "e", "s", "t").count() == 0
