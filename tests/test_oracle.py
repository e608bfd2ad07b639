"""Every registered query against its SQL on the small data."""

import pytest
from conftest import SF

import __spark_entry__ as entry
from checks.compare import compare, connect

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        assert compare(got, duck.execute(ORACLE[name]).df()) == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)
