"""Layer 1: every query with oracle SQL equals DuckDB on the same tables."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck
from conftest import SF_SMALL

SQL = E.oracle_sql()
QUERIES = E.queries()


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.sql(SQL[name]).df()
    ok, msg = compare(got, want)
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "mape" in df.columns
