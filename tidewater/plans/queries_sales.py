"""Registered sales-report queries."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.datetime import year_month
from tidewater.plans import views
from tidewater.plans.daily_store import DailyStore
from tidewater.plans.registry import register
from tidewater.plans.sales_report import (
    backfill_reports,
    daily_sales,
    day_text,
    month_filter,
    monthly_sales_report,
    persist_report,
    persist_reports,
    read_report,
    report_target_column,
    validate_month,
)
from tidewater.session import scratch_path

# The report month used by the checks: sales exist in it at every scale.
REPORT_MONTH = "1998-03"

_REPORT_SQL = f"""
WITH sales AS ({views.SALES_SQL}), products AS ({views.PRODUCTS_SQL}),
daily AS (
  SELECT product_id, substring(CAST("timestamp" AS VARCHAR), 1, 10) AS date,
         sum(CAST(price AS DOUBLE) * CAST(quantity AS INTEGER)) AS daily_sale_amount
  FROM sales WHERE starts_with(CAST("timestamp" AS VARCHAR), '{REPORT_MONTH}')
  GROUP BY product_id, substring(CAST("timestamp" AS VARCHAR), 1, 10)
)
SELECT p.product_name AS product, d.date AS date, round(d.daily_sale_amount, 2) AS sale
FROM daily d JOIN products p ON d.product_id = p.product_id
ORDER BY product, date
"""


@register("monthly_sales_report", "K01 K02 K03 C01 C03 C04 C05 E01 D01 F03", _REPORT_SQL)
def q_monthly_sales_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = validate_month(REPORT_MONTH)
    return monthly_sales_report(views.sales(spark, sf_dir), views.products(spark, sf_dir), month)


@register(
    "sales_month_filter",
    "C01 K03",
    f"""WITH sales AS ({views.SALES_SQL})
SELECT "timestamp", product_id, quantity, price FROM sales
WHERE starts_with(CAST("timestamp" AS VARCHAR), '{REPORT_MONTH}')""",
)
def q_sales_month_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return month_filter(views.sales(spark, sf_dir), validate_month(REPORT_MONTH))


@register(
    "sales_daily_amount",
    "C03 C04 E01",
    f"""WITH sales AS ({views.SALES_SQL})
SELECT product_id, substring(CAST("timestamp" AS VARCHAR), 1, 10) AS date,
       round(sum(CAST(price AS DOUBLE) * CAST(quantity AS INTEGER)), 2) AS daily_sale_amount
FROM sales WHERE starts_with(CAST("timestamp" AS VARCHAR), '{REPORT_MONTH}')
GROUP BY 1, 2""",
)
def q_sales_daily_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = daily_sales(views.sales(spark, sf_dir), REPORT_MONTH)
    return daily.select(
        "product_id",
        day_text("sale_date", daily.schema["sale_date"].dataType).alias("date"),
        F.round("daily_sale_amount", 2).alias("daily_sale_amount"),
    )


@register(
    "report_partitioned_write",
    "B05 B11 I22",
    f"""WITH r AS ({_REPORT_SQL})
SELECT product, date, sale, 'sales_report_' || replace('{REPORT_MONTH}', '-', '_') AS target FROM r""",
)
def q_report_partitioned_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the month twice; its folder is replaced, which leaves one copy."""
    path = scratch_path(spark, "sales_report")
    for _ in range(2):
        report = monthly_sales_report(
            views.sales(spark, sf_dir), views.products(spark, sf_dir), REPORT_MONTH, sort=False
        )
        persist_report(report, path, REPORT_MONTH)
    return read_report(spark, path, REPORT_MONTH).withColumn(
        "target", report_target_column(F.lit(REPORT_MONTH))
    )


@register("monthly_sales_report_text", "C01 C03 K02", _REPORT_SQL)
def q_monthly_sales_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over text timestamps (as a document store may deliver them):
    the month filter is then the reference's own prefix test and the day is the
    first ten characters."""
    sales = views.sales(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("string"))
    return monthly_sales_report(sales, views.products(spark, sf_dir), validate_month(REPORT_MONTH))


BACKFILL_MONTHS = [f"1998-{m:02d}" for m in range(1, 13)]
_BACKFILL_IN = ", ".join(f"'{m}'" for m in BACKFILL_MONTHS)


@register(
    "report_backfill_write",
    "K02 E01 D01 B05 B11",
    f"""WITH sales AS ({views.SALES_SQL}), products AS ({views.PRODUCTS_SQL}),
daily AS (
  SELECT product_id, substring(CAST("timestamp" AS VARCHAR), 1, 10) AS date,
         substring(CAST("timestamp" AS VARCHAR), 1, 7) AS month,
         sum(CAST(price AS DOUBLE) * CAST(quantity AS INTEGER)) AS daily_sale_amount
  FROM sales WHERE substring(CAST("timestamp" AS VARCHAR), 1, 7) IN ({_BACKFILL_IN})
  GROUP BY 1, 2, 3
)
SELECT p.product_name AS product, d.date AS date, round(d.daily_sale_amount, 2) AS sale, d.month AS month
FROM daily d JOIN products p ON d.product_id = p.product_id""",
)
def q_report_backfill_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve months in one scan and one write; a rerun replaces them, never duplicates."""
    path = scratch_path(spark, "sales_report_backfill")
    for _ in range(2):
        reports = backfill_reports(views.sales(spark, sf_dir), views.products(spark, sf_dir), BACKFILL_MONTHS)
        persist_reports(reports, path, months=BACKFILL_MONTHS)
    return spark.read.parquet(path).select("product", "date", "sale", F.col("month").cast("string").alias("month"))


EMPTIED_MONTH = "1998-03"


@register(
    "report_empty_rerun",
    "K02 B05 B11",
    f"""WITH sales AS ({views.SALES_SQL}), products AS ({views.PRODUCTS_SQL}),
daily AS (
  SELECT product_id, substring(CAST("timestamp" AS VARCHAR), 1, 10) AS date,
         substring(CAST("timestamp" AS VARCHAR), 1, 7) AS month,
         sum(CAST(price AS DOUBLE) * CAST(quantity AS INTEGER)) AS daily_sale_amount
  FROM sales WHERE substring(CAST("timestamp" AS VARCHAR), 1, 7) IN ({_BACKFILL_IN})
    AND substring(CAST("timestamp" AS VARCHAR), 1, 7) <> '{EMPTIED_MONTH}'
  GROUP BY 1, 2, 3
)
SELECT p.product_name AS product, d.date AS date, round(d.daily_sale_amount, 2) AS sale, d.month AS month
FROM daily d JOIN products p ON d.product_id = p.product_id""",
)
def q_report_empty_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All months are written, then again after the sales of one month were withdrawn: that month ends empty."""
    path = scratch_path(spark, "sales_report_emptied")
    sales, products = views.sales(spark, sf_dir), views.products(spark, sf_dir)
    withdrawn = year_month("timestamp") == EMPTIED_MONTH
    for source in (sales, sales.filter(~withdrawn)):
        persist_reports(backfill_reports(source, products, BACKFILL_MONTHS), path, months=BACKFILL_MONTHS)
    return spark.read.parquet(path).select("product", "date", "sale", F.col("month").cast("string").alias("month"))


@register("monthly_sales_report_zoned", "C01 C03 K02", _REPORT_SQL)
def q_monthly_sales_report_zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over zoned timestamps (TIMESTAMP with the session's zone, as a
    document store returns them): the month range and the day are read in the
    session zone, as the text of such a timestamp is."""
    sales = views.sales(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return monthly_sales_report(sales, views.products(spark, sf_dir), validate_month(REPORT_MONTH))


@register("monthly_sales_report_lenient", "C04 K02", _REPORT_SQL)
def q_monthly_sales_report_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over text-typed numbers (as loosely typed documents deliver
    them), read with ``try_cast`` so a malformed value would be NULL, not fatal."""
    sales = views.sales(spark, sf_dir).select(
        "timestamp", "product_id", F.col("quantity").cast("string").alias("quantity"),
        F.col("price").cast("string").alias("price"),
    )
    return monthly_sales_report(sales, views.products(spark, sf_dir), validate_month(REPORT_MONTH), lenient=True)


@register("report_incremental", "E01 E07 G02 K02", _REPORT_SQL)
def q_report_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report month arrives in two loads: all days up to its 15th, then the days after the high-water mark.

    A third load up to the same day finds nothing to do.  The report reads the
    stored days and no sales.
    """
    sales, products = views.sales(spark, sf_dir), views.products(spark, sf_dir)
    store = DailyStore(spark, scratch_path(spark, "daily_sales"), sales.schema["product_id"].dataType)
    middle, end = _dt.date.fromisoformat(f"{REPORT_MONTH}-15"), _dt.date.fromisoformat(f"{REPORT_MONTH}-31")
    for until in (middle, end, end):
        store.load(sales, until)
    return store.report(products, REPORT_MONTH)
