"""Every registered query with a SQL twin must agree with it."""

import pytest

import __spark_entry__ as contract
from tests import oracle

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return oracle.connect(folder)


def test_contract(spark):
    assert set(SQL) <= set(QUERIES)
    assert contract.entry(spark).count() == 11


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, folder, duck):
    frame = QUERIES[name](spark, folder)
    assert not any("decimal" in kind for _, kind in frame.dtypes)
    assert oracle.difference(oracle.spark_table(frame), oracle.duck_table(duck, SQL[name])) is None
