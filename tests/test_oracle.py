"""Every registered query equals its SQL on the whole tables."""

import pytest
from conftest import SF, SMALL_SF
from oracle import connect, difference

import __spark_entry__ as entry_module
from tidegrid.plans import catalog

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= entry_module.queries().items()


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF).toArrow()
    assert difference(result, duck.sql(ORACLES[name]).to_arrow_table()) is None


def test_entry_on_smallest_data(spark):
    assert entry_module.entry(spark).count() == 130
    assert SMALL_SF in entry_module.entry(spark).inputFiles()[0]
