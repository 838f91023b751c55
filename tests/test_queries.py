"""Every registered query against its SQL, on whole tables; those without SQL give rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF))
    want_columns, want = sql_rows(con, SQL[name])
    assert columns == want_columns
    assert rows == want
    assert rows or name in ()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["pair_id", "gap"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
