"""Every registered query against its SQL on the smallest scale."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from earshot.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() == 50


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert differences(df, con, SQL[name]) == []
    assert not df.isEmpty(), "nothing was compared"
