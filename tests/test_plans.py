"""Shapes of physical plans."""

import re

import pytest
from conftest import SF

from tidegrid.operators.arbitrage import daily_arbitrage
from tidegrid.operators.groups import oversized_groups
from tidegrid.operators.windows import DAY, rolling_trailing
from tidegrid.plans import catalog
from tidegrid.plans.catalog import event_prices, order_prices
from tidegrid.functions.calendar import trade_day

QUERIES = catalog.QUERIES

# The one operator that runs Python on the workers.
PYTHON_QUERIES = {"market_csv"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(plan, node):
    return len(re.findall(rf"^[\s:+\-|*()\d]*{node}\b", plan, re.MULTILINE))


@pytest.mark.parametrize("name", QUERIES)
def test_no_pairwise_joins_and_no_row_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert ("MapInArrow" in plan) == (name in PYTHON_QUERIES)


def test_daily_arbitrage_shuffles_and_sorts_once(spark):
    plan = plan_of(daily_arbitrage(event_prices(spark, SF)))
    assert count(plan, "Exchange") == 1 and count(plan, "Sort") == 1 and count(plan, "Window") == 2
    assert count(plan, "SortAggregate") == 2
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_unused_window_columns_are_pruned(spark):
    assert "stddev" not in plan_of(daily_arbitrage(event_prices(spark, SF)))


def test_trailing_windows_never_partition_rows_by_region_alone(spark):
    """Only the borrowed month edges are shuffled by region."""
    plan = plan_of(rolling_trailing(order_prices(spark, SF), max_group_rows=None))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    by_region_only = [k for k in keys if "month" not in k]
    assert len(by_region_only) == 1 and len(keys) == 3
    assert count(plan, "WindowGroupLimit") == 2


def test_group_check_reads_keys_only(spark):
    dated = event_prices(spark, SF).withColumn("trade_date", trade_day("SETTLEMENTDATE"))
    counts = dated.groupBy(*DAY).count()
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan_of(counts)
    assert oversized_groups(dated, DAY, 60).count() > 100
    assert oversized_groups(dated, DAY, 1000) is None and oversized_groups(dated, DAY, None) is None


def test_filters_reach_the_scan(spark):
    plan = plan_of(QUERIES["filter_range"](spark, SF))
    assert "In(event_type, [purchase,view])" in plan and "GreaterThanOrEqual(ts," in plan
