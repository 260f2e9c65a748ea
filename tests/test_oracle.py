"""Every registered query against its DuckDB statement on the smallest tables."""

import pytest

import __spark_entry__ as contract
from compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    sql = contract.oracle_sql().get(name)
    ok, message = compare(spark, con, name, contract.queries()[name], sql, SF_DIR)
    assert ok, message


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 2


def test_statements_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
