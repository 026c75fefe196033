"""Every registered query against its SQL statement."""

import pytest

import __spark_entry__ as e
from tests.compare import connect, difference
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(e.queries()))
def test_query(spark, con, name):
    df = e.queries()[name](spark, SF_DIR)
    sql = e.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, sql) is None


def test_entry(spark):
    assert e.entry(spark).count() > 0
