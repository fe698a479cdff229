"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import pytest

import __spark_entry__
import compare

SF_DIR = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def database():
    con = compare.database(SF_DIR)
    yield con
    con.close()


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, database, name):
    assert compare.difference(QUERIES[name](spark, SF_DIR), database, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
