"""Planted spikes, stuck and impossible values among drift, level changes and downtime."""

from datetime import datetime, timedelta, timezone

import numpy as np

from shoal.operators.spikes import BINS, gpd_cutoff, implausible_readings

SCHEMA = "reading_id long, pump_id string, timestamp timestamp, vibration_mm_s double, bearing_temp_c double, rpm double, channel string"
T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


def pump(name, seed, first, hours=300):
    g = np.random.default_rng(seed)
    h = np.arange(hours)
    v = (2 + 0.004 * h) * (1 + 0.03 * g.standard_normal(hours))
    t = 50 + 4 * np.sin(h / 24 * 2 * np.pi) + 0.5 * g.standard_normal(hours)
    r = 1480 + 3 * g.standard_normal(hours)
    return [[first + int(i), name, T0 + timedelta(hours=int(i)), round(float(v[i]), 3), round(float(t[i]), 2), round(float(r[i]), 1), "x"] for i in h]


def test_planted_cases(spark):
    a, b = pump("a", 1, 0), pump("b", 2, 1000)
    want = set()

    def put(rows, ch, at, values, case=True):
        col = {"vibration_mm_s": 3, "bearing_temp_c": 4, "rpm": 5}[ch]
        for i, x in enumerate(values):
            rows[at + i][col] = x
            if case:
                want.add((rows[at + i][0], ch))

    put(a, "vibration_mm_s", 40, [6.5])
    put(a, "bearing_temp_c", 60, [75.0, 74.0, 76.0])
    put(a, "rpm", 80, [1300.0, 1302.0])
    put(a, "rpm", 100, [1481.0] * 6)
    put(a, "rpm", 110, [1481.0] * 5, case=False)
    put(a, "vibration_mm_s", 130, [-0.5])
    put(a, "bearing_temp_c", 131, [-70.0])
    put(a, "rpm", 132, [65535.0])
    # no cases: outages, nulls, five hours up, a lasting change of level, equal values during downtime
    put(a, "rpm", 150, [-999.0] * 8, case=False)
    put(a, "rpm", 165, [None], case=False)
    put(b, "bearing_temp_c", 50, [80.0, 81.0, 80.0, 82.0, 80.0], case=False)
    for i in range(200, 300):
        b[i][5] += 200
    put(b, "rpm", 120, [0.0] * 20, case=False)
    data = [tuple(x) for x in a + b] + [tuple(a[40]), tuple(b[3])]
    data += [(5000, None, T0, 500.0, 20.0, 100.0, "x"), (5001, "c", None, 1.0, 400.0, 100.0, "x"), (5002, "d", T0, 1.0, 1.0, 1.0, "x")]
    want |= {(5000, "vibration_mm_s"), (5001, "bearing_temp_c")}
    start = int(T0.timestamp())
    periods = spark.createDataFrame([("b", start + 120 * 3600, start + 140 * 3600)], "pump_id string, start_s long, end_s long")
    got = {tuple(r) for r in implausible_readings(spark.createDataFrame(data, SCHEMA), periods).collect()}
    assert got == want
    assert implausible_readings(spark.createDataFrame([], SCHEMA), periods).count() == 0


def test_blocks_agree(spark, monkeypatch):
    import shoal.operators.spikes as S

    rows = pump("a", 5, 0, 600)
    rows[100][5], rows[299][3], rows[300][3], rows[301][3] = 1700.0, 9.0, 9.1, 9.2
    for i in range(398, 405):
        rows[i][4] = 51.0
    df = spark.createDataFrame([tuple(x) for x in rows], SCHEMA)
    none = spark.createDataFrame([], "pump_id string, start_s long, end_s long")
    whole = {tuple(r) for r in implausible_readings(df, none).collect()}
    monkeypatch.setattr(S, "BLOCK_HOURS", 100)
    assert {tuple(r) for r in implausible_readings(df, none).collect()} == whole
    assert {r[0] for r in whole} == {100, 299, 300, 301, *range(398, 405)}


def test_cutoff_grows_with_noise_and_risk():
    g = np.random.default_rng(0)
    h = lambda s: np.bincount(np.minimum((np.abs(g.standard_normal(50_000)) * s / 0.125).astype(int), BINS - 1), minlength=BINS).astype(float)
    one, two = h(1.0), h(1.3)
    assert 4.5 < gpd_cutoff(one, one, 1e-6) < 10
    assert gpd_cutoff(two, two, 1e-6) > gpd_cutoff(one, one, 1e-6)
    assert gpd_cutoff(one, one, 1e-8) > gpd_cutoff(one, one, 1e-4)
    # a few spikes in the tail don't move it much
    dirty = one.copy()
    dirty[-1] += 200
    assert abs(gpd_cutoff(dirty, dirty, 1e-6) - gpd_cutoff(one, one, 1e-6)) < 1.0
    assert gpd_cutoff(np.zeros(BINS), np.zeros(BINS), 1e-6) == 6.0


def test_the_fitted_tail_decides(spark, monkeypatch):
    import shoal.operators.spikes as S

    g = np.random.default_rng(3)
    calm, wild = [], pump("wild", 7, 100_000, 6000)
    for k in range(5):
        rows = pump(f"calm{k}", k, 10_000 * k, 3000)
        for r, e in zip(rows, g.normal(0, 1, 3000)):
            r[4] = 60.0 + float(e)
        calm += rows
    for r, e in zip(wild, g.standard_t(3, 6000)):
        r[4] = 60.0 + float(e)
    calm[2000][4] = 60.0 + 25.0
    df = spark.createDataFrame([tuple(x) for x in calm + wild], SCHEMA)
    none = spark.createDataFrame([], "pump_id string, start_s long, end_s long")
    got = {r[0] for r in implausible_readings(df, none).filter("channel = 'bearing_temp_c'").collect()}
    cut = {r["pump_id"]: r["cut"] for r in S.source_tails(df, none).filter("channel = 'bearing_temp_c'").collect()}
    assert calm[2000][0] in got and cut["wild"] > cut["calm0"] + 2, cut
    # a constant in its place flags other readings
    monkeypatch.setattr(S, "gpd_tail", lambda *a, **k: (float("nan"),) * 4 + (6.0,))
    assert {r[0] for r in implausible_readings(df, none).filter("channel = 'bearing_temp_c'").collect()} != got
