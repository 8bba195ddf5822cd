"""Every named query against its SQL on the smallest tables; those without SQL run and have a stable schema."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("SHOAL_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(DATA)):
        at = f"{DATA}/{f}/*.parquet" if os.path.isdir(f"{DATA}/{f}") else f"{DATA}/{f}"
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{at}')")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect()), key=str)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    r = con.execute(sql)
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in sorted(cols)]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).columns


def test_core_does_not_need_the_optional_part():
    root = os.path.dirname(entry.__file__)
    for folder, _, names in os.walk(f"{root}/shoal"):
        if folder.startswith(f"{root}/shoal/llm"):
            continue
        for n in names:
            if n.endswith(".py"):
                assert "shoal.llm" not in open(f"{folder}/{n}").read(), n
