"""Every registered query runs; those with SQL equal DuckDB value by value."""

import pytest

import __spark_entry__ as entry
from oracle import connect, difference

SF = "/root/testdata/sf0.01"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_learned_query_gives_rows(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 5 and "mean_velocity" in df.columns


def test_names():
    assert set(SQL) <= set(QUERIES)
