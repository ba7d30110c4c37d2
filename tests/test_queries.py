"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__
from driver_queries import ORACLES, QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, db, name):
    problem = compare(spark, db, FOLDER, QUERIES[name], ORACLES[name])
    assert problem in (None, "no rows"), problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(1).count() == 1


def test_entry_has_rows(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0
    assert rows.columns == __spark_entry__.entry(spark).columns


def test_contract_lists_every_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
