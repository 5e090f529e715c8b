"""Every registered query of the engine itself against its SQL oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from quire.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in os.listdir(SF)] if os.path.isdir(SF) else []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    value = lambda x: round(x, 6) if isinstance(x, float) and math.isfinite(x) else x
    return sorted(tuple(str(value(x)) for x in r) for r in rows)


@pytest.mark.skipif(not TABLES, reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert rows
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name])
        assert sorted(want.columns) == columns
        order = [want.columns.index(c) for c in columns]
        assert plain(rows) == plain([tuple(r[k] for k in order) for r in want.fetchall()])


@pytest.mark.skipif(not TABLES, reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
