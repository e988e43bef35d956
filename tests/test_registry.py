"""Every registered query against its SQL at the smallest scale; queries without SQL must give rows."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    text, _ = compare(spark, duck, QUERIES[name], SQL.get(name), SF)
    assert not text.startswith("FAIL"), text


def test_every_sql_has_a_query(spark):
    assert set(SQL) <= set(QUERIES)
    assert entry.entry(spark).count() > 0
