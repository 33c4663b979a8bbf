"""Every query outside the training-data subpackage against DuckDB, and the entry points."""

import pytest

import __spark_entry__
from ripplegrid.jobs import catalog
from tests.oracle import differences, duck

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    if name in SQL:
        assert differences(df, SQL[name], con) == []
    else:
        assert df.count() > 0


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
