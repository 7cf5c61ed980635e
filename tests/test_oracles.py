import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, duck

SF = "/root/testdata/sf0.01"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, queries()[name], SQL[name], SF) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
