"""Every registered query next to its comparison statement on the smallest tables."""

import pytest
from harness import compare, connect

import __spark_entry__ as contract

QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_contract(spark):
    assert set(SQL) <= set(QUERIES)
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, sf_dir, duck):
    assert compare(QUERIES[name](spark, sf_dir), duck, SQL[name]) == []
