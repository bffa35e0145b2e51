"""Every query with SQL against DuckDB, value by value."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


def plain(v):
    """A value as it is compared: nothing is rounded, and NaN is not null."""
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


CORE = sorted(n for n in entry.oracle_sql() if not n[:2].rstrip("_") in {f"p{k}" for k in range(1, 10)})


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "suspicion_score" in df.columns


def test_pushdown(spark):
    plan = entry.queries()["S6_cluster_pushdown"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "EqualTo(cluster,1)" in plan and "document" not in plan.split("ReadSchema")[1].split("\n")[0]
