"""Every query of the library against its SQL, on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float) and math.isnan(x):
        return "None"
    if isinstance(x, (int, float)):
        return f"{float(x):.9g}" if abs(x) < 2**50 else str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    order = [want.columns.index(c) for c in names]
    left = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    right = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert left == right


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
