"""Registered queries against their SQL, and what the entry offers."""

import pytest
from llm_fixtures import SF
from oracle import connect, difference

import __spark_entry__ as entry_module
from tidegrid.llm import queries


def test_every_operator_is_registered_once():
    names = [n.split("_")[0] for n in queries.QUERIES if n.startswith("op")]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14)) and "pipeline" in queries.QUERIES
    assert queries.QUERIES.items() <= entry_module.queries().items()


@pytest.mark.parametrize("name", queries.ORACLES)
def test_matches_sql(spark, name):
    result = queries.QUERIES[name](spark, SF).toArrow()
    assert difference(result, connect(SF).sql(queries.ORACLES[name]).to_arrow_table()) is None


@pytest.mark.parametrize("name", ["op2_url_filter", "op5_decontamination", "op6_quality_rules", "op9_mix_sources"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
