"""Units from identities and notes; instants from mixtures, notes and clocks."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from shoal.operators.stamps import resolve_stamps, source_mixtures, stamp_readings
from shoal.operators.units import common_units, reading_units, solve_units


def test_product_identity_finds_units(spark):
    rnd, data = random.Random(1), []
    for src, fm, fd, fv in (("a", 1.0, 1.0, 1.0), ("b", 1000.0, 1.0, 1000.0), ("c", 1.0, 1000.0, 1.0)):
        for _ in range(40):
            v, rho = rnd.uniform(0.1, 5), rnd.uniform(600, 1400)
            data.append((src, v * rho * fm * rnd.uniform(0.99, 1.01), rho / fd, v * fv))
    data += [("d", None, 1.0, 2.0), ("d", -1.0, 1.0, 2.0), (None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "src string, mass double, density double, volume double")
    units = {"mass": {"kg": 1.0, "g": 1e-3}, "density": {"kg/m3": 1.0, "g/cm3": 1000.0}, "volume": {"m3": 1.0, "l": 1e-3}}
    got = {r["src"]: r for r in solve_units(df, "src", units, [{"mass": 1, "density": -1, "volume": -1}]).collect()}
    # grams with litres look the same as kilograms with cubic metres: not unique, so left open
    assert not got["b"]["unique"] and got["b"]["mass_unit"] is None
    assert got["c"]["residual"] < 0.01
    assert not got["d"]["unique"]
    # a second identity settles it
    two = solve_units(df.withColumnRenamed("mass", "mass"), "src", {"density": units["density"], "mass": {"kg": 1.0}, "volume": {"m3": 1.0}}, [{"mass": 1, "density": -1, "volume": -1}])
    got = {r["src"]: r for r in two.collect()}
    assert got["a"]["density_unit"] == "kg/m3" and got["c"]["density_unit"] == "g/cm3" and got["a"]["unique"]


READ = "line_id string, stream string, quantity string, class string, raw string, unit string"


def test_notes_and_evidence_give_units(spark):
    data = [
        ("1", "s", "temp", "bare", "86.0", None), ("2", "s", "pres", "bare", "14.50377", None), ("3", "s", "temp", "printed", "300.15", "K"),
        ("4", "p", "temp", "packed", "+00886", None), ("5", "p", "pres", "packed", "0012204", None),
        ("6", "u", "temp", "bare", "310.0", None), ("7", "u", "temp", "printed", "40.0", "C"), ("8", "u", "pres", "bare", "x", None),
    ]
    notes = [("s", "s", "Bare readings: Fahrenheit and psi. Dates as mm/dd."), ("p", "p", "Fixed-width numbers carry no point: hundredths of degC and kPa."), ("u", "u", None), ("u", "u", None)]
    read = spark.createDataFrame(data, READ)
    u = reading_units(read, spark.createDataFrame(notes, "stream string, program string, notes string"))
    got = {(r[0], r[1]): r[2] for r in common_units(read, u).collect()}
    assert got == {("1", "temp"): 300, ("2", "pres"): 1000, ("3", "temp"): 270, ("4", "temp"): 89, ("5", "pres"): 1220, ("6", "temp"): 369, ("7", "temp"): 400}
    assert common_units(read.limit(0), u).count() == 0


E = "line_id string, stream string, site string, stamp_kind string, stamp string, zone string, arrived timestamp"
SITES = [("BER", 60, "Europe/Berlin"), ("KOK", 330, None)]


def instants(spark, data, notes, sites=SITES):
    read = stamp_readings(
        spark.createDataFrame(data, E), spark.createDataFrame(notes, "stream string, notes string"), spark.createDataFrame(sites, "site string, utc_offset_min int, tz_name string")
    )
    return {r["line_id"]: (r["utc_ms"], r["unresolved"]) for r in resolve_stamps(read, source_mixtures(read)).collect()}


def ms(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1000)


def test_declared_clocks_and_daylight_saving(spark):
    a = datetime(2025, 11, 1, tzinfo=timezone.utc)
    local = "Local time at the plant. Slash dates start with the day."
    data = [
        ("twice", "l", "BER", "plain", "2025-10-26 02:30:00", None, a),
        ("summer", "l", "BER", "slash24", "05/07/2025 12:00", None, a),
        ("half", "l", "KOK", "slash12", "05/07/25 12:05AM", None, a),
        ("zoned", "l", "BER", "dmon", "05-Jul-2025 12:00:00", "EST", a),
        ("iso", "l", "XX", "iso", "2025-07-05T12:00:00.3919", "+0545", a),
        ("epoch", "l", "XX", "epoch", "1763433432173", None, a),
        ("epochs", "l", None, "epoch", "1763433432", None, a),
        ("unlisted", "l", "XX", "packed", "2507051200", None, a),
        ("nodate", "l", "BER", "slash24", "35/07/2025 12:00", None, a),
        ("oddzone", "l", "BER", "dmon", "05-Jul-2025 12:00:00", "QQQ", a),
        ("utc", "u", "XX", "14", "20250705120000", None, a),
        ("month", "u", "XX", "slash24", "07/05/2025 12:00", None, a),
    ]
    got = instants(spark, data, [("l", local), ("u", "All stamps in UTC. Dates as mm/dd.")])
    assert got == {
        "twice": (ms(2025, 10, 26, 0, 30), False), "summer": (ms(2025, 7, 5, 10), False), "half": (ms(2025, 7, 4, 18, 35), False), "zoned": (ms(2025, 7, 5, 17), False),
        "iso": (ms(2025, 7, 5, 6, 15) + 391, False), "epoch": (1763433432173, False), "epochs": (1763433432000, False), "utc": (ms(2025, 7, 5, 12), False), "month": (ms(2025, 7, 5, 12), False),
    }


def test_mixture_without_notes(spark):
    data, want = [], {}
    for i in range(60):
        t = datetime(2025, 3, 1, tzinfo=timezone.utc) + timedelta(hours=7 * i)
        loc = t + timedelta(minutes=330)
        data.append((f"a{i}", "a", "KOK", "slash24", loc.strftime("%d/%m/%Y %H:%M"), None, t + timedelta(minutes=5)))
        want[f"a{i}"] = int(t.timestamp() * 1000)
    got = instants(spark, data, [("a", None)])
    assert {k: v[0] for k, v in got.items()} == want


def test_ambiguity_is_marked(spark):
    # no arrival, no notes: day or month first, site or UTC are all as likely
    got = instants(spark, [("x", "s", "KOK", "slash24", "05/07/2025 12:00", None, None), ("y", "s", "KOK", "slash24", "05/05/2025 12:00", None, None)], [("s", "")])
    assert got["x"] == (None, True) and got["y"][1]
    assert instants(spark, [], [("s", "")]) == {}


@pytest.mark.parametrize("zone,minutes", [("Z", 0), ("+05:45", 345), ("-0330", -210), ("UTC+09:00", 540), ("AEST", 600), ("??", None)])
def test_zones(spark, zone, minutes):
    from pyspark.sql import functions as F

    from shoal.operators.stamps import zone_minutes

    assert spark.range(1).select(zone_minutes(F.lit(zone))).first()[0] == minutes


def test_the_mixture_decides_late_stamps(spark):
    # forty prompt lines fix the source's clock and order; one late line can't be told but by them
    data, late = [], datetime(2025, 3, 5, 6, tzinfo=timezone.utc)
    for i in range(40):
        t = datetime(2025, 3, 13, tzinfo=timezone.utc) + timedelta(hours=7 * i)
        data.append((f"a{i}", "a", "KOK", "slash24", (t + timedelta(minutes=330)).strftime("%d/%m/%Y %H:%M"), None, t + timedelta(minutes=5)))
    data.append(("late", "a", "KOK", "slash24", "03/05/2025 11:30", None, datetime(2025, 5, 8, tzinfo=timezone.utc)))
    got = instants(spark, data, [("a", None)])
    assert got["late"] == (ms(2025, 5, 3, 6), False)
    from pyspark.sql import functions as F

    read = stamp_readings(spark.createDataFrame(data, E), spark.createDataFrame([("a", None)], "stream string, notes string"), spark.createDataFrame(SITES, "site string, utc_offset_min int, tz_name string"))
    flat = source_mixtures(read).withColumn("weights", F.array(*[F.lit(0.25)] * 4))
    assert {r["line_id"]: r["unresolved"] for r in resolve_stamps(read, flat).collect()}["late"]
    assert late < data[-1][-1]


def test_wording_is_learned_from_told_sources(spark):
    from shoal.operators.wording import wording_prior

    texts = [(f"s{i}", f"The {'kettle' if i % 2 else 'gong'} rules. Filed by desk {i % 7}.") for i in range(60)] + [("x", "the kettle rules here"), ("n", None)]
    known = [(f"s{i}", "a" if i % 2 else "b") for i in range(50)]
    p = wording_prior(spark.createDataFrame(texts, "s string, notes string"), "s", "notes", spark.createDataFrame(known, "s string, label string"), ["a", "b"], {})
    got = {r["s"]: r["prior"] for r in p.collect()}
    assert got["s51"][0] > 0.95 and got["s52"][1] > 0.95 and got["x"][0] > 0.95 and abs(got["n"][0] - 0.5) < 0.02


def test_identities_decide_before_notes(spark):
    rnd, data = random.Random(2), []
    for i in range(30):
        c = rnd.uniform(10, 90)
        data += [(f"b{i}", "s", "temp", "bare", f"{c * 1.8 + 32:.1f}", None), (f"p{i}", "s", "temp", "printed", f"{rnd.uniform(10, 90):.1f}", "C")]
    read = spark.createDataFrame(data, READ)
    # the notes are wrong, and the identity doesn't leave the choice to them
    got = reading_units(read, spark.createDataFrame([("s", "s", "Bare readings: kelvin and psi.")], "stream string, program string, notes string")).collect()
    assert [(r["quantity"], r["unit"], r["unique"]) for r in got] == [("temp", "F", True)]
