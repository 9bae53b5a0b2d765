"""All queries against their SQL on the smallest data, where it is there."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
NAMES = sorted(n for n in entry.queries() if not n[1:2].isdigit() or n.startswith(("p1_", "p3_")))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str, datetime.date)):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    want = db.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    assert not [t for t in map(str, want.types) if t.endswith("[]") or t in ("HUGEINT", "UHUGEINT") or t.startswith(("DECIMAL", "STRUCT", "MAP"))]  # types that both sides show alike
    columns = sorted(df.columns)
    places = [want.columns.index(c) for c in columns]
    a = sorted("|".join(plain(r[c]) for c in columns) for r in got)
    b = sorted("|".join(plain(r[p]) for p in places) for r in want.fetchall())
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
