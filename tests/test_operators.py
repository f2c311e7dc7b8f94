"""Joins, guards, latest-per-group, incremental loads, quality checks."""

from __future__ import annotations

import datetime as dt

import pytest

from tests.plan_utils import explain_text
from tidewater.operators import columns as C
from tidewater.operators.incremental import absent_rows, days_to_load, high_water_mark
from tidewater.operators.joins import JOIN_KINDS, join, join_kind, join_without_duplicates, new_columns
from tidewater.operators.latest import latest_per_group
from tidewater.operators.quality import row_count_checks
from tidewater.operators.scan import filtered_scan


def test_join_names():
    assert join_kind("full") == "full_outer" and join_kind("LEFT") == "left_outer"
    assert set(JOIN_KINDS.values()) == {"inner", "full_outer", "left_outer", "right_outer", "left_semi", "left_anti"}
    with pytest.raises(ValueError):
        join_kind("cross")
    with pytest.raises(ValueError):
        join_kind("sideways")


def test_all_join_kinds(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k INT, x STRING")
    b = spark.createDataFrame([(2, "B"), (3, "C")], "k INT, y STRING")
    counts = {how: join(a, b, "k", how).count() for how in JOIN_KINDS}
    assert counts == {
        "inner": 1, "full": 3, "full_outer": 3, "left": 2, "left_outer": 2,
        "right": 2, "right_outer": 2, "left_semi": 1, "left_anti": 1,
    }


def test_join_without_duplicates(spark):
    assert new_columns(["a", "b"], ["b", "c", "c", "d"]) == ["c", "d"]
    left = spark.createDataFrame([(1, "n1", 10)], "o_custkey INT, name STRING, v INT")
    right = spark.createDataFrame([(1, "other", 5, "seg")], "c_custkey INT, name STRING, w INT, seg STRING")
    out = join_without_duplicates(left, right, ["o_custkey"], ["c_custkey"], "left")
    assert out.columns == ["o_custkey", "name", "v", "w", "seg"]
    assert tuple(out.first()) == (1, "n1", 10, 5, "seg")


def test_guards(spark):
    df = spark.createDataFrame([(1, 2)], "a INT, b INT")
    C.require_columns(df, "a", "b")
    C.require_any_column(df, "z", "a")
    C.require_absent(df, "z")
    with pytest.raises(ValueError):
        C.require_columns(df, "a", "z")
    with pytest.raises(ValueError):
        C.require_any_column(df, "y", "z")
    with pytest.raises(ValueError):
        C.require_absent(df, "a")
    assert C.project(df, ["b"]).columns == ["b"]
    assert C.project(df, "b", "a").columns == ["b", "a"]


def test_drop_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, 3)], "a INT, b INT")
    assert C.drop_nulls(df, "any").count() == 1
    assert C.drop_nulls(df, "all").count() == 2
    with pytest.raises(ValueError):
        C.drop_nulls(df, "some")


def test_preview_is_top_k(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    top = C.preview(df, 3, order_by=["k"])
    assert [r.k for r in top.collect()] == [0, 1, 2]
    assert "TakeOrderedAndProject" in explain_text(top)


def test_latest_per_group_is_an_aggregate(spark):
    df = spark.createDataFrame(
        [("a", 1, 10, "x"), ("a", 2, 5, "y"), ("a", 2, 7, "z"), ("b", 1, 1, "w")], "g STRING, t INT, id INT, v STRING"
    )
    out = latest_per_group(df, "g", ["t", "id"])
    assert sorted(tuple(r) for r in out.collect()) == [("a", 2, 7, "z"), ("b", 1, 1, "w")]
    plan = explain_text(out)
    # A partial aggregate runs before the exchange: no group is ever collected whole in one task.
    assert "Window" not in plan and "partial_max" in plan


def test_incremental(spark):
    loaded = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 5),), (dt.datetime(2024, 1, 3),), (None,)], "ts TIMESTAMP_NTZ"
    )
    assert high_water_mark(loaded, "ts").first()[0] == dt.date(2024, 1, 3)
    missing = [r.missing_day for r in days_to_load(loaded, "ts", dt.date(2024, 1, 5)).orderBy("missing_day").collect()]
    assert missing == [dt.date(2024, 1, 4), dt.date(2024, 1, 5)]  # the gap before the newest day stays
    assert days_to_load(loaded, "ts", dt.date(2024, 1, 3)).count() == 0
    empty = loaded.limit(0)
    assert days_to_load(empty, "ts", dt.date(2024, 12, 31), lookback_months=1).count() == 32
    new = spark.createDataFrame([(1, "a"), (2, "b")], "k INT, v STRING")
    old = spark.createDataFrame([(2, "zz")], "k INT, v STRING")
    assert [r.k for r in absent_rows(new, old, ["k"]).collect()] == [1]


def test_quality(spark):
    a = spark.range(12)
    out = {r.check_name: (r.row_count, r.passed) for r in row_count_checks({"p": (a, 10), "r": (a.limit(0), 1)}).collect()}
    assert out == {"p": (12, True), "r": (0, False)}


def test_filtered_scan_pushdown(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    assert filtered_scan(part).count() == part.count()
    out = filtered_scan(part, "p_size > 40", ["p_partkey", "p_name"])
    assert out.columns == ["p_partkey", "p_name"]
    plan = explain_text(out)
    assert "GreaterThan(p_size,40)" in plan and "ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int>" in plan


def test_log_preview_prints_schema_and_rows(spark, capsys):
    df = spark.createDataFrame([(1, "a")], "k INT, v STRING")
    assert C.log_preview(df, "demo", 5) is df
    out = capsys.readouterr().out
    assert "== demo ==" in out and "|-- k: integer" in out
    C.log_preview(df, "off", enabled=False)
    assert capsys.readouterr().out == ""


def test_scale_settings():
    from tidewater.session import scale_settings

    s = scale_settings(100 * 1024**4, 8000)
    assert int(s["spark.sql.shuffle.partitions"]) == 409600
    assert scale_settings(10, 8)["spark.sql.shuffle.partitions"] == "16"
