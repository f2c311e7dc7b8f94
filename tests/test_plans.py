"""Plan properties of every registered query: built-in expressions only, no
all-pairs joins, no window that would pin a group to one task."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tidewater.plans.registry import load_all
from tests.plan_utils import explain_text

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "Window")


@pytest.mark.parametrize("name", sorted(load_all()))
def test_plan_is_spark_native(spark, name):
    plan = explain_text(entry.queries()[name](spark, SF), "extended")
    found = [f for f in FORBIDDEN if f in plan]
    assert not found, f"{name}: {found}"


def test_report_plan_shape(spark):
    plan = explain_text(entry.queries()["monthly_sales_report"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan
    assert "partial_sum" in plan


def test_latest_per_job_aggregates_partially(spark):
    plan = explain_text(entry.queries()["runs_latest_per_job"](spark, SF))
    assert "partial_max" in plan and "PushedFilters: [In(event_type" in plan
    assert "SortAggregate" not in plan


@pytest.mark.parametrize(
    "name, hash_exchanges, range_exchanges",
    [
        ("monthly_sales_report", 1, 1),  # partial -> final sum, then the sort
        ("sales_daily_amount", 1, 0),
        ("log_parse_errors", 0, 0),  # per-row work only
        ("runs_count_by_job", 1, 0),
        ("runs_latest_per_job", 2, 0),  # one exchange per key, of one partial result a group and task; no window
        ("runs_page", 0, 0),  # top-k, no global sort exchange
    ],
)
def test_exchange_counts(spark, name, hash_exchanges, range_exchanges):
    plan = explain_text(entry.queries()[name](spark, "/root/testdata/sf0.01"), "simple")
    assert plan.count("Exchange hashpartitioning") == hash_exchanges, plan
    assert plan.count("Exchange rangepartitioning") == range_exchanges, plan


@pytest.mark.parametrize(
    "name, read_schema",
    [
        # counting open runs needs only what decides end_time
        ("runs_count", "struct<event_id:bigint,ts:timestamp_ntz,value:double>"),
        ("runs_job_names", "struct<event_type:string>"),
        ("project_columns", "struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>"),
    ],
)
def test_scans_read_only_needed_columns(spark, name, read_schema):
    plan = explain_text(entry.queries()[name](spark, SF), "simple")
    assert f"ReadSchema: {read_schema}" in plan, plan
