"""Every registered query with SQL gives the same rows as the SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, folder, con, name):
    assert compare(entry.queries()[name](spark, folder), con, SQL[name]) == ""


def test_contract(spark):
    assert set(SQL) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
