"""Every registered query runs on the small tables; those with SQL give the same rows there."""

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert "z_score" in entry(spark).columns


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    got_cols, got = check.rows_of(df.columns, df.collect())
    sql = oracle_sql().get(name)
    if sql is None:
        return
    rel = con.execute(sql)
    want_cols, want = check.rows_of([d[0] for d in rel.description], rel.fetchall())
    assert got_cols == want_cols
    assert got == want
