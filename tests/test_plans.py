"""Structural guards over every registered plan (built on the smallest fixture)."""

import pytest

from quarry.plans import REGISTRY

# Cross products and row-at-a-time Python UDFs have no place in any plan:
# pairs would grow quadratically, per-row Python leaves codegen.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
# Sort-based aggregates are allowed only where the input is small by
# construction (prefix hits of distinct names, distinct (run, model) pairs).
SORT_AGGREGATE_OK = {"cost_prefix", "token_rollup", "validate_runs", "rescore_runs", "soft_f1_questions"}


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_plan_shape(spark, name):
    """No cross products or row UDFs anywhere; hash aggregates except where allowed."""
    df = REGISTRY[name].build(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [op for op in FORBIDDEN if op in plan]
    assert name in SORT_AGGREGATE_OK or "SortAggregate" not in plan


@pytest.mark.parametrize("name", ["join_multi", "join_chain", "avg_ship_days", "filter_time", "join_anti"])
def test_scans_are_pruned(spark, name):
    """Headline joins read only the columns they use (no full-width scans)."""
    df = REGISTRY[name].build(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "FileScan parquet" in line and "lineitem.parquet" in line:
            assert "l_tax" not in line and "l_returnflag" not in line
        if "FileScan parquet" in line and "orders.parquet" in line:
            assert "o_orderpriority" not in line


def test_first_row_limit_is_map_side(spark):
    """First-row de-duplication keeps one row per key in every map task
    before the shuffle (a hot key never reaches one task whole)."""
    df = REGISTRY["dedup_lineitem"].build(spark, "/root/testdata/sf0.001")
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    ex = next(i for i, l in enumerate(lines) if "Exchange hashpartitioning" in l)
    assert any("WindowGroupLimit" in l for l in lines[ex + 1:])      # below the exchange: map side
