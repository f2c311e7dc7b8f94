"""Registered relational queries."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.columns import drop_nulls, preview, project
from tidewater.operators.incremental import absent_rows, days_to_load, high_water_mark
from tidewater.operators.joins import join_keys, join_without_duplicates
from tidewater.operators.skew import skew_safe_join
from tidewater.operators.quality import CountedOutputs, row_count_checks
from tidewater.operators.scan import filtered_scan
from tidewater.plans import views
from tidewater.plans.queries_sales import REPORT_MONTH
from tidewater.plans.registry import register
from tidewater.plans.sales_report import monthly_sales_report, persist_report
from tidewater.session import scratch_path
from tidewater.sources import files

# "Yesterday" of the incremental load, pinned so results repeat.
LOAD_UNTIL = _dt.date(2001, 12, 31)
# Day of the first of two loads of an insert-if-absent.
LOADED_UNTIL = _dt.date(1996, 6, 30)

# Join inputs: all customers and all events.  Most customers have no event and
# each kind of row occurs at any size, so the join kinds differ on whole tables.
_C = "SELECT c_custkey, c_name, c_mktsegment FROM customer"
_E = "SELECT event_id, user_id, event_type FROM events"
_J_COLS = "c.c_custkey, c.c_name, c.c_mktsegment, e.event_id, e.user_id, e.event_type"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")


def _join_query(how: str, sql_how: str, rows: str) -> None:
    @register(
        f"join_{how}",
        rows,
        f"SELECT {_J_COLS} FROM ({_C}) c {sql_how} JOIN ({_E}) e ON c.c_custkey = e.user_id",
    )
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Events per customer may be heavily skewed: the outer kinds deal hot customers over slices.
        return skew_safe_join(_customers(spark, sf_dir), _events(spark, sf_dir), ["c_custkey"], ["user_id"], how)

    q.__name__ = f"q_join_{how}"


_join_query("inner", "INNER", "D01 D08")
_join_query("left", "LEFT", "D03")
_join_query("right", "RIGHT", "D04")
_join_query("full", "FULL OUTER", "D02")


@register(
    "join_semi",
    "D05",
    f"SELECT * FROM ({_C}) c WHERE EXISTS (SELECT 1 FROM ({_E}) e WHERE e.user_id = c.c_custkey)",
)
def q_join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew_safe_join(_customers(spark, sf_dir), _events(spark, sf_dir), ["c_custkey"], ["user_id"], "left_semi")


@register(
    "join_anti",
    "D06",
    f"SELECT * FROM ({_C}) c WHERE NOT EXISTS (SELECT 1 FROM ({_E}) e WHERE e.user_id = c.c_custkey)",
)
def q_join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew_safe_join(_customers(spark, sf_dir), _events(spark, sf_dir), ["c_custkey"], ["user_id"], "left_anti")


@register(
    "join_no_dup_columns",
    "D09",
    """SELECT o.*, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def q_join_no_dup_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders")
    customer = views.table(spark, sf_dir, "customer")
    return join_without_duplicates(orders, customer, ["o_custkey"], ["c_custkey"], "left")


@register("project_columns", "C08 C09", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_project_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(views.table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


@register(
    "preview_rows",
    "C10",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8",
)
def q_preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = project(views.table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_totalprice")
    return preview(orders, 8, order_by=[F.col("o_totalprice").desc(), F.col("o_orderkey")])


_LEFT_JOINED = f"SELECT {_J_COLS} FROM ({_C}) c LEFT JOIN ({_E}) e ON c.c_custkey = e.user_id"


@register(
    "drop_nulls",
    "C11",
    f"SELECT * FROM ({_LEFT_JOINED}) WHERE event_id IS NOT NULL AND event_type IS NOT NULL",
)
def q_drop_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_keys(_customers(spark, sf_dir), _events(spark, sf_dir), ["c_custkey"], ["user_id"], "left")
    return drop_nulls(joined, "any", ["event_id", "event_type"])


@register(
    "drop_nulls_all",
    "C11",
    f"SELECT * FROM ({_LEFT_JOINED}) WHERE NOT (event_id IS NULL AND event_type IS NULL)",
)
def q_drop_nulls_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_keys(_customers(spark, sf_dir), _events(spark, sf_dir), ["c_custkey"], ["user_id"], "left")
    return drop_nulls(joined, "all", ["event_id", "event_type"])


@register(
    "source_filter_project",
    "A13 A14",
    "SELECT p_partkey, upper(p_brand) AS brand, p_retailprice FROM part WHERE p_size > 40 AND p_retailprice < 1500",
)
def q_source_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered_scan(
        views.table(spark, sf_dir, "part"),
        "p_size > 40 AND p_retailprice < 1500",
        ["p_partkey", "upper(p_brand) AS brand", "p_retailprice"],
    )


@register(
    "sales_high_water",
    "E07 F04",
    "SELECT max(CAST(l_shipdate AS DATE)) AS high_water_day FROM lineitem",
)
def q_sales_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return high_water_mark(views.sales(spark, sf_dir), "timestamp")


@register(
    "sales_missing_days",
    "G02",
    f"""SELECT CAST(d AS DATE) AS missing_day
FROM generate_series((SELECT max(CAST(l_shipdate AS DATE)) + 1 FROM lineitem)::TIMESTAMP,
                     DATE '{LOAD_UNTIL.isoformat()}'::TIMESTAMP, INTERVAL 1 DAY) t(d)""",
)
def q_sales_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days_to_load(views.sales(spark, sf_dir), "timestamp", LOAD_UNTIL)


@register(
    "products_absent",
    "G01",
    f"""WITH p AS ({views.PRODUCTS_SQL})
SELECT product_id, product_name FROM p
WHERE product_id NOT IN (SELECT DISTINCT l_partkey FROM lineitem)""",
)
def q_products_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products without any sale: the rows an insert-if-absent would add."""
    sold = views.sales(spark, sf_dir).select("product_id")
    return absent_rows(views.products(spark, sf_dir), sold, ["product_id"])


@register(
    "load_if_absent",
    "G01",
    f"""WITH p AS ({views.PRODUCTS_SQL}), sold AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '{LOADED_UNTIL}')
SELECT product_id, product_name, product_id IN (SELECT k FROM sold) AS loaded_before FROM p
WHERE product_id IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT c_custkey, c_name, false FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)""",
)
def q_load_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into one table: the products sold by a day, then those sold since and the customers without an event.

    The second load appends only what is absent, so a product that was sold
    before and after the day is in the table once.
    """
    products, sales = views.products(spark, sf_dir), views.sales(spark, sf_dir)
    until = F.lit(LOADED_UNTIL + _dt.timedelta(days=1)).cast("timestamp_ntz")
    first = products.join(sales.filter(F.col("timestamp") < until).select("product_id").distinct(), "product_id", "left_semi")
    out = files.FileOptions(path=scratch_path(spark, "absent"), save_mode="append")
    files.write(first.withColumn("loaded_before", F.lit(True)), out)
    schema = "product_id BIGINT, product_name STRING, loaded_before BOOLEAN"
    again = products.join(sales.select("product_id").distinct(), "product_id", "left_semi")
    files.write(absent_rows(again, files.read(spark, out, schema), ["product_id"]).withColumn("loaded_before", F.lit(False)), out)
    idle = absent_rows(
        _customers(spark, sf_dir).select(F.col("c_custkey").alias("user_id"), "c_name"), _events(spark, sf_dir), ["user_id"]
    )
    idle = idle.select(F.col("user_id").cast("long").alias("product_id"), F.col("c_name").alias("product_name"), F.lit(False).alias("loaded_before"))
    return files.read(spark, out, schema).unionByName(idle)


@register(
    "quality_counts",
    "E08",
    f"""WITH r AS (SELECT count(*) AS n FROM (
  SELECT l_partkey, CAST(l_shipdate AS DATE) FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE starts_with(CAST(l_shipdate AS VARCHAR), '{REPORT_MONTH}') GROUP BY 1, 2))
SELECT 'products' AS check_name, (SELECT count(*) FROM part) AS row_count, CAST(10 AS BIGINT) AS min_rows,
       (SELECT count(*) FROM part) >= 10 AS passed
UNION ALL
SELECT 'sales_report', n, CAST(1 AS BIGINT), n >= 1 FROM r""",
)
def q_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts taken in the job that writes the report: sales are scanned once, the report is computed once."""
    counted = CountedOutputs(spark)
    products = counted.watch("products", views.products(spark, sf_dir), 10)
    report = monthly_sales_report(views.sales(spark, sf_dir), products, REPORT_MONTH, sort=False)
    persist_report(counted.watch("sales_report", report, 1), scratch_path(spark, "checked_report"), REPORT_MONTH)
    return counted.checks()


@register(
    "quality_counts_read",
    "E08",
    f"""SELECT 'runs' AS check_name, count(*) AS row_count, CAST(1 AS BIGINT) AS min_rows, count(*) >= 1 AS passed FROM events
UNION ALL SELECT 'open_runs', count(*) FILTER (WHERE event_id % 10 = 0), CAST(1000000000 AS BIGINT), false FROM events""",
)
def q_quality_counts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of frames that nobody writes: counted, one of them below its minimum."""
    runs = views.runs(spark, sf_dir)
    return row_count_checks({"runs": (runs, 1), "open_runs": (runs.filter("end_time IS NULL"), 1_000_000_000)})
