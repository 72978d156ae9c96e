"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from check import TABLES, normal, types_differ

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    assert got
    sql = entry_module.oracle_sql().get(name)
    if sql is not None:
        cur = duck.execute(sql)
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert not types_differ(df, cur.description)
        assert normal(cur.fetchall(), columns) == got


def test_entry(spark):
    assert entry_module.entry(spark).count() == 33


def test_every_sql_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
