"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    rows, only_spark, only_sql = compare(df, con, sql)
    assert rows > 0 and not only_spark and not only_sql, (only_spark, only_sql)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
