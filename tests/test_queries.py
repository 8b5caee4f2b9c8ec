"""Every registered query runs; those with SQL give the same rows."""

import os

import pytest

from corvane import catalog
from tests.oracle import connect, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def oracle():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, oracle, name):
    df = catalog.queries()[name](spark, SF)
    columns, rows = rows_of_spark(df)
    if sql := catalog.oracle_sql().get(name):
        assert (columns, rows) == rows_of_sql(oracle, sql)
    else:
        assert columns and rows


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
