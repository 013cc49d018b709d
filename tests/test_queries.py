"""Every query with a SQL counterpart, both engines side by side on the smallest tables."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES) and len(SQL) > 100


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    verdict, _ = compare(spark, SF, name, QUERIES[name], SQL[name], con)
    assert verdict == "ok"
