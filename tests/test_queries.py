"""Each query against its SQL in DuckDB, whole results."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from meterloom.plans.table_queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, queries()[name], oracle_sql()[name], SF_DIR) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["l_orderkey", "l_linenumber", "prediction"]
    assert df.count() > 0
