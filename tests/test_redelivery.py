"""Repeated deliveries against brute force, over several commits, out of order and past the watermark."""

import random
from datetime import datetime, timedelta, timezone

from shoal.streaming.redelivery import find_redeliveries

SCHEMA = "row_id long, user_id string, item_id string, event_type string, timestamp timestamp, batch_id int, received_at timestamp"
T0 = datetime(2025, 1, 6, tzinfo=timezone.utc)


def brute(data):
    first, out = {}, []
    norm = lambda s: None if s is None else s.strip().lower()
    for r in sorted(data, key=lambda r: (r[6], r[0])):
        if r[1] is None or r[4] is None:
            continue
        k = (norm(r[1]), norm(r[2]), norm(r[3]), r[4])
        if k in first:
            out.append(r[0])
        first.setdefault(k, r[0])
    return sorted(out)


def find(spark, path, **kw):
    df = find_redeliveries(
        spark, path, ["user_id", "item_id", "event_type", "timestamp"], "timestamp", "received_at", "row_id", ["user_id", "timestamp"], **kw
    )
    return sorted(r[0] for r in df.collect())


def make(seed, n=600):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if out and rnd.random() < 0.4:
            _, u, it, ev, ts, b, rc = rnd.choice(out)
            # a third of all rows is one message
            if rnd.random() < 0.5:
                _, u, it, ev, ts, b, rc = out[0]
            u = None if u is None else rnd.choice([u, f" {u}", u.lower(), f"{u}\t"])
            rc = rc + timedelta(hours=rnd.choice([0, 1, 50, 400]))
        else:
            ts = T0 + timedelta(hours=rnd.randrange(0, 900)) if rnd.random() > 0.03 else None
            u = rnd.choice(["U1", "U2", "U3", None])
            it, ev = rnd.choice(["I1", "I2", None]), rnd.choice(["view", "cart", None])
            b, rc = i, (ts or T0) + timedelta(minutes=rnd.randrange(0, 600))
        out.append((i, u, it, ev, ts, b, rc))
    return out


def test_against_brute_force(spark, tmp_path):
    data = make(1)
    for name, delay, order in (("a", "10 days", lambda r: r[6]), ("b", "1 hour", lambda r: r[6]), ("c", "1 hour", lambda r: -r[0])):
        path = str(tmp_path / f"{name}.parquet")
        rows = sorted(data, key=order)
        for i in range(4):
            spark.createDataFrame(rows[i * 150 : (i + 1) * 150], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        assert find(spark, path, delay=delay, buckets=3, maxFilesPerTrigger="1") == brute(data)


def test_one_commit_and_one_file(spark, tmp_path):
    data = make(2, 200)
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(path)
    assert find(spark, path) == brute(data)


def test_ties_nulls_and_empty(spark, tmp_path):
    same = (T0, 1, T0)
    data = [(5, "a", "x", "v", *same), (3, "A ", "X", "V", *same), (4, None, "x", "v", *same), (6, "a", "x", "v", None, 1, T0), (7, "a", None, "v", *same), (8, "a", None, "v", *same)]
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(data, SCHEMA).write.parquet(path)
    # the smaller row id is first; nulls agree with nulls only
    assert find(spark, path) == [5, 8]
    empty = str(tmp_path / "e.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(empty)
    assert find(spark, empty) == []


def test_the_store_expires_and_looks_up_late(spark, tmp_path):
    from shoal.streaming.redelivery import delivery_kinds

    data = make(4)
    # one message again, months after its slot has expired
    data.append((9000, *data[0][1:6], T0 + timedelta(days=200)))
    for i in range(400):
        at = T0 + timedelta(days=60, hours=8 * i)
        data.append((10_000 + i, f"U{i}", "I9", "view", at, 1, at))
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(path)
    args = (["user_id", "item_id", "event_type", "timestamp"], "timestamp", "received_at", "row_id", ["user_id", "timestamp"])
    kinds = {r["kind"]: r["count"] for r in delivery_kinds(spark, path, *args, commits=5).groupBy("kind").count().collect()}
    # 1 repeat, 2 late, 3 expired
    assert kinds[1] > 0 and kinds[2] >= 1 and kinds[3] > 0
    assert find(spark, path, commits=5) == brute(data)
    assert find(spark, path, delay="1 hour", buckets=2, commits=7) == brute(data)
