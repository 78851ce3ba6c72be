"""Every query against its SQL check."""

import pytest
from check_oracle import compare, duck
from conftest import SMALL

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SMALL), con, SQL[name]) is None
    spark.catalog.clearCache()
