"""Semantics of the monthly report on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.plan_utils import explain_text

from tidewater.plans.sales_report import (
    build_report,
    daily_sales,
    month_filter,
    monthly_sales_report,
    persist_report,
    read_report,
    report_target_name,
    validate_month,
)

SALES_DDL = "timestamp TIMESTAMP_NTZ, product_id STRING, quantity INT, price DOUBLE"


def _sales(spark, rows, ddl=SALES_DDL):
    return spark.createDataFrame(rows, ddl)


def _products(spark, rows):
    return spark.createDataFrame(rows, "product_id STRING, product_name STRING")


def test_report_aggregates_then_joins(spark):
    sales = _sales(
        spark,
        [
            (dt.datetime(2024, 11, 1, 10), "1001", 2, 10.5),
            (dt.datetime(2024, 11, 1, 23, 30), "1001", 1, 5.0),
            (dt.datetime(2024, 11, 2, 0, 0), "1002", 3, 100.0),
            (dt.datetime(2024, 10, 31, 23, 59, 59), "1001", 1, 999.0),  # previous month
            (dt.datetime(2024, 12, 1, 0, 0), "1001", 1, 999.0),  # next month
            (None, "1001", 1, 999.0),  # NULL timestamp drops out
            (dt.datetime(2024, 11, 3), "9999", 1, 1.0),  # sale without product
        ],
    )
    products = _products(spark, [("1001", "TV"), ("1002", "Sofa"), ("1003", "Bed")])  # Bed has no sales
    rows = [tuple(r) for r in monthly_sales_report(sales, products, "2024-11").collect()]
    assert rows == [("Sofa", "2024-11-02", 300.0), ("TV", "2024-11-01", 26.0)]


def test_two_products_with_one_name_stay_two_rows(spark):
    sales = _sales(spark, [(dt.datetime(2024, 11, 5), "1", 1, 1.0), (dt.datetime(2024, 11, 5), "2", 1, 2.0)])
    products = _products(spark, [("1", "Chair"), ("2", "Chair")])
    rows = sorted(tuple(r) for r in monthly_sales_report(sales, products, "2024-11").collect())
    assert rows == [("Chair", "2024-11-05", 1.0), ("Chair", "2024-11-05", 2.0)]


def test_month_edge_is_read_in_session_zone(spark):
    # 23:30 UTC on Oct 31 is Nov 1 in Asia/Kolkata: a zoned timestamp follows the session zone.
    prev = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ts = spark.sql("SELECT TIMESTAMP '2024-10-31 23:30:00' AS timestamp")
        assert month_filter(ts, "2024-11").count() == 0
        assert month_filter(ts, "2024-10").count() == 1
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        assert month_filter(ts, "2024-11").count() == 1
        assert month_filter(ts, "2024-10").count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)


def test_string_timestamps_use_prefix(spark):
    df = spark.createDataFrame(
        [("2024-11-30 10:00:00", "1", 1, 2.0), ("2024-12-01 00:00:00", "1", 1, 2.0), (None, "1", 1, 2.0)],
        "timestamp STRING, product_id STRING, quantity INT, price DOUBLE",
    )
    assert month_filter(df, "2024-11").count() == 1
    daily = daily_sales(df, "2024-11").collect()
    assert [(r.sale_date, r.daily_sale_amount) for r in daily] == [("2024-11-30", 2.0)]
    odd = spark.createDataFrame([("2024-11-3x junk", "1", 1, 2.0)], "timestamp STRING, product_id STRING, quantity INT, price DOUBLE")
    report = monthly_sales_report(odd, _products(spark, [("1", "TV")]), "2024-11").collect()
    assert [tuple(r) for r in report] == [("TV", "2024-11-3x", 2.0)]


def test_text_in_price_fails_strict_and_nulls_lenient(spark):
    df = spark.createDataFrame(
        [("2024-11-01 00:00:00", "1", "2", "abc"), ("2024-11-01 00:00:00", "1", "3", "1.5")],
        "timestamp STRING, product_id STRING, quantity STRING, price STRING",
    )
    with pytest.raises(Exception):
        daily_sales(df, "2024-11").collect()
    rows = daily_sales(df, "2024-11", lenient=True).collect()
    assert [r.daily_sale_amount for r in rows] == [4.5]


def test_month_filter_pushes_range_to_parquet(spark):
    from tidewater.plans import views

    plan = explain_text(month_filter(views.sales(spark, "/root/testdata/sf0.001"), "1998-03"))
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan


def test_validate_month():
    today = dt.date(2024, 11, 15)
    assert validate_month(None, today=today) == "2024-11"
    assert validate_month("2024-10", today=today) == "2024-10"
    with pytest.raises(ValueError):
        validate_month("2024-12", today=today)
    with pytest.raises(ValueError):
        validate_month("2024-13", today=today)
    with pytest.raises(ValueError):
        validate_month("24-11", today=today)


def test_target_name():
    assert report_target_name("2024-11") == "sales_report_2024_11"


def test_persist_is_idempotent_per_month(spark, tmp_dir):
    sales = _sales(spark, [(dt.datetime(2024, 11, 1), "1", 1, 1.0), (dt.datetime(2024, 10, 1), "1", 2, 1.0)])
    products = _products(spark, [("1", "TV")])
    for month in ("2024-10", "2024-11", "2024-11"):
        persist_report(monthly_sales_report(sales, products, month), tmp_dir, month)
    assert read_report(spark, tmp_dir, "2024-11").count() == 1
    assert read_report(spark, tmp_dir, "2024-10").count() == 1


def test_rerun_without_rows_empties_the_month(spark, tmp_dir):
    from tidewater.plans.sales_report import backfill_reports, persist_reports

    sales = _sales(spark, [(dt.datetime(2024, 11, 1), "1", 1, 1.0), (dt.datetime(2024, 10, 1), "1", 2, 1.0)])
    products = _products(spark, [("1", "TV")])
    months = ["2024-10", "2024-11"]
    persist_reports(backfill_reports(sales, products, months), tmp_dir, months=months)
    persist_report(monthly_sales_report(sales.limit(0), products, "2024-11"), tmp_dir, "2024-11")
    assert read_report(spark, tmp_dir, "2024-11").count() == 0
    assert read_report(spark, tmp_dir, "2024-10").count() == 1
    persist_reports(backfill_reports(sales.filter("quantity = 1"), products, months), tmp_dir, months=months)
    assert read_report(spark, tmp_dir, "2024-11").count() == 1
    assert read_report(spark, tmp_dir, "2024-10").count() == 0


def test_backfill_pushes_each_span_of_months():
    from tidewater.plans.sales_report import month_spans

    spans = month_spans(["1996-01", "2000-11", "2000-12", "2001-01"])
    assert spans == [(dt.datetime(1996, 1, 1), dt.datetime(1996, 2, 1)), (dt.datetime(2000, 11, 1), dt.datetime(2001, 2, 1))]


def test_build_report_rounds_and_sorts(spark):
    daily = spark.createDataFrame(
        [("2", dt.date(2024, 11, 2), 0.1 + 0.2), ("1", dt.date(2024, 11, 3), 1.005), ("1", dt.date(2024, 11, 1), 3.0)],
        "product_id STRING, sale_date DATE, daily_sale_amount DOUBLE",
    )
    products = _products(spark, [("1", "A"), ("2", "B")])
    out = build_report(daily, products).collect()
    assert [r.product for r in out] == ["A", "A", "B"]
    assert [r.date for r in out] == ["2024-11-01", "2024-11-03", "2024-11-02"]
    assert out[2].sale == 0.3
    assert build_report(daily, products).columns == ["product", "date", "sale"]


def test_partition_pruning_on_month_partitioned_sales(spark, tmp_dir):
    rows = [(dt.datetime(2024, m, 3), "1", 1, float(m)) for m in (10, 11, 12)]
    sales = _sales(spark, rows).withColumn("sale_month", F.date_format("timestamp", "yyyy-MM"))
    sales.write.partitionBy("sale_month").parquet(tmp_dir + "/sales")
    stored = spark.read.parquet(tmp_dir + "/sales")
    report = monthly_sales_report(stored, _products(spark, [("1", "TV")]), "2024-11", partition_col="sale_month")
    assert [tuple(r) for r in report.collect()] == [("TV", "2024-11-03", 11.0)]
    assert "PartitionFilters: [isnotnull(sale_month" in explain_text(report)


@pytest.mark.parametrize("as_text", [False, True])
def test_backfill_equals_single_months(spark, as_text):
    from tidewater.plans import views
    from tidewater.plans.sales_report import backfill_reports

    sales = views.sales(spark, "/root/testdata/sf0.001")
    if as_text:
        sales = sales.withColumn("timestamp", F.col("timestamp").cast("string"))
    products = views.products(spark, "/root/testdata/sf0.001")
    months = ["1997-12", "1998-01", "1998-03"]
    got = sorted(tuple(r) for r in backfill_reports(sales, products, months).collect())
    want = sorted(
        (*tuple(r), m) for m in months for r in monthly_sales_report(sales, products, m).collect()
    )
    assert got == want and len(got) > 0


def test_wall_clock_range_ignores_session_zone(spark):
    prev = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame(
        [(dt.datetime(1998, 3, 1, 0, 0),), (dt.datetime(1998, 3, 31, 23, 59, 59, 999999),), (dt.datetime(1998, 4, 1),)],
        "timestamp TIMESTAMP_NTZ",
    )
    try:
        for zone in ("Asia/Kolkata", "America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = sorted(r.timestamp for r in month_filter(df, "1998-03").collect())
            assert got == [dt.datetime(1998, 3, 1), dt.datetime(1998, 3, 31, 23, 59, 59, 999999)], zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)


def test_lenient_reads_numeric_text(spark):
    df = spark.createDataFrame(
        [("2024-11-01 00:00:00", "1", "17.0", "2.5"), ("2024-11-01 00:00:00", "1", "x", "1.0")],
        "timestamp STRING, product_id STRING, quantity STRING, price STRING",
    )
    rows = daily_sales(df, "2024-11", lenient=True).collect()
    assert [r.daily_sale_amount for r in rows] == [42.5]
