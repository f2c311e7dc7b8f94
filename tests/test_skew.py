"""The skew-safe outer join equals the plain one, including NULL keys and a hot key."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.plan_utils import explain_text
from tidewater.operators.joins import join_keys
from tidewater.operators.skew import hot_keys, skew_safe_join


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, x) for x in t))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_equals_plain_join(spark, how):
    cust = spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, "c"), (None, "n")], "c_key INT, c_name STRING"
    )
    # key 1 is hot: a third and more of all orders
    orders = [(i, 1, float(i)) for i in range(40)] + [(100 + i, 2, 1.0) for i in range(5)]
    orders += [(200, 9, 2.0), (201, None, 3.0)]
    ords = spark.createDataFrame(orders, "o_id INT, o_key INT, o_amount DOUBLE")
    plain = join_keys(cust, ords, ["c_key"], ["o_key"], how)
    safe = skew_safe_join(cust, ords, ["c_key"], ["o_key"], how)
    assert safe.columns == plain.columns
    assert _rows(safe) == _rows(plain)


def _hot_sides(spark):
    """One right key with a third of all rows, a left key hot as well, one hot on both sides, and many NULL keys."""
    left = [(i, 2) for i in range(90)] + [(1000, 1), (1001, 7), (1002, 8)] + [(2000 + i, 3) for i in range(30)] + [(3000 + i, None) for i in range(60)]
    right = [(i, 1) for i in range(300)] + [(5000 + i, 3) for i in range(40)] + [(6000 + i, 100 + i) for i in range(60)] + [(7000 + i, None) for i in range(80)]
    right += [(8000, 2), (8001, 7)]
    return spark.createDataFrame(left, "a_id INT, a_key INT"), spark.createDataFrame(right, "b_id INT, b_key BIGINT")


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_sliced_hot_keys_equal_the_plain_join(spark, how):
    a, b = _hot_sides(spark)
    hot, _, limit = hot_keys(a, b, ["a_key"], ["b_key"], rows_per_slice=20)
    assert limit == 20 and {r[0]: r[1:] for r in hot} == {1: (1, 300), 2: (90, 1), 3: (30, 40)}
    safe = skew_safe_join(a, b, ["a_key"], ["b_key"], how, rows_per_slice=20)
    assert _rows(safe) == _rows(join_keys(a, b, ["a_key"], ["b_key"], how))


def test_two_key_columns_and_equal_rows(spark):
    a = spark.createDataFrame([(1, "x", 5)] * 50 + [(1, None, 6), (None, None, 7)], "p INT, q STRING, a INT")
    b = spark.createDataFrame([(1, "x", i) for i in range(70)] + [(1, "y", 0), (None, "x", 1)], "r INT, s STRING, b INT")
    safe = skew_safe_join(a, b, ["p", "q"], ["r", "s"], "full", rows_per_slice=10)
    assert _rows(safe) == _rows(join_keys(a, b, ["p", "q"], ["r", "s"], "full"))


@pytest.mark.parametrize("how,scans", [("left", 2), ("right", 2), ("full", 2)])
def test_the_plan_reads_each_side_once(spark, how, scans):
    c = spark.read.parquet(f"{SF_SMALL}/customer.parquet").select("c_custkey", "c_name")
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "user_id")
    for limit in (None, 1):  # without and with sliced keys
        plan = explain_text(skew_safe_join(c, e, ["c_custkey"], ["user_id"], how, rows_per_slice=limit), "simple")
        assert plan.count("FileScan parquet") == scans


def test_a_key_with_a_third_of_the_rows_is_spread_over_the_tasks(spark):
    """Rows that reach each task of a shuffled left join whose right side is hot (which AQE cannot split)."""
    tasks = 16
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        n = 60_000
        orders = spark.range(n).select(F.col("id").alias("o_id"), F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 1, None).otherwise(F.col("id") % 5000).alias("o_key"))
        cust = spark.range(5000).select(F.col("id").alias("c_key"))
        per_task = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("t")).count().collect())
        plain = per_task(join_keys(cust, orders, ["c_key"], ["o_key"], "full"))
        safe = per_task(skew_safe_join(cust, orders, ["c_key"], ["o_key"], "full", rows_per_slice=n // 400))
        assert sum(plain) == sum(safe)
        assert plain[-1] > 5 * plain[len(plain) // 2]
        assert len(safe) == tasks and safe[-1] < 2 * safe[len(safe) // 2]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_no_hot_keys_and_empty_sides(spark):
    a, b = _hot_sides(spark)
    assert hot_keys(a, b, ["a_key"], ["b_key"])[0] == []  # below the fewest rows worth slicing
    for x, y in ((a.limit(0), b), (a, b.limit(0)), (a.limit(0), b.limit(0))):
        assert _rows(skew_safe_join(x, y, ["a_key"], ["b_key"], "full", rows_per_slice=5)) == _rows(join_keys(x, y, ["a_key"], ["b_key"], "full"))


def test_no_all_pairs_for_cross(spark):
    a = spark.range(2)
    with pytest.raises(ValueError):
        skew_safe_join(a, a.withColumnRenamed("id", "x"), ["id"], ["x"], "cross")
