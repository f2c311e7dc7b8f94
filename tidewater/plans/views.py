"""Reference-shaped views over the generated test tables.

Each view is a projection (no shuffle), so Catalyst prunes the underlying
Parquet scan to the columns a query actually uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.datetime import render, year_month
from tidewater.functions.logs import render_log_line

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sales`` documents: one row per line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``products`` documents: one row per part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
    )


#: Thread names of the rendered log lines.
THREADS = ("http-worker", "nightly-batch", "queue-reader-2")


def log_fields(events: DataFrame) -> DataFrame:
    """Structured log fields from events: ERROR for error events, else INFO."""
    thread = F.when(F.col("event_id") % 3 == 0, THREADS[0]).when(
        F.col("event_id") % 3 == 1, THREADS[1]
    ).otherwise(THREADS[2])
    return events.select(
        F.col("event_id"),
        render("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("stamp"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.col("user_id").alias("pid"),
        F.concat(F.lit("App"), (F.col("event_id") % 5).cast("string")).alias("application"),
        thread.alias("thread"),
        F.concat(F.lit("com.example.events."), F.initcap("event_type"), F.lit("Handler")).alias("clazz"),
        F.concat(
            F.col("event_type"), F.lit(" handled at file_"), F.col("user_id").cast("string"),
            F.lit(".log. Cause value "), F.format_string("%.2f", F.col("value")),
        ).alias("message"),
    )


def log_lines(spark: SparkSession, sf_dir: str, with_id: bool = False) -> DataFrame:
    """Rendered log lines (I25), one per event."""
    f = log_fields(table(spark, sf_dir, "events"))
    line = render_log_line(
        F.col("stamp"), F.col("level"), F.col("pid"), F.col("application"),
        F.col("thread"), F.col("clazz"), F.col("message"),
    ).alias("log_line")
    return f.select("event_id", line) if with_id else f.select(line)


# SQL text of the same views, shared by the DuckDB oracles.
SALES_SQL = (
    "SELECT l_shipdate AS \"timestamp\", l_partkey AS product_id, "
    "l_quantity AS quantity, l_extendedprice AS price FROM lineitem"
)
PRODUCTS_SQL = "SELECT p_partkey AS product_id, p_name AS product_name FROM part"
LOG_LINES_SQL = """
SELECT event_id,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' || ' '
  || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' '
  || CAST(user_id AS VARCHAR) || ' --- [App' || CAST(event_id % 5 AS VARCHAR) || '] [  '
  || CASE event_id % 3 WHEN 0 THEN 'http-worker' WHEN 1 THEN 'nightly-batch' ELSE 'queue-reader-2' END
  || '] com.example.events.' || upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) || 'Handler'
  || '     : ' || event_type || ' handled at file_' || CAST(user_id AS VARCHAR)
  || '.log. Cause value ' || printf('%.2f', value) AS log_line
FROM events
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task-store rows derived from events: one run per event.

    Every tenth run is still open; every seventh failed, every eleventh was
    stopped; failed ``purchase`` runs carry the invalid-date error, other
    failures the unknown error.
    """
    e = table(spark, sf_dir, "events")
    open_run = F.col("event_id") % 10 == 0
    exit_code = (
        F.when(F.col("event_id") % 7 == 0, 1).when(F.col("event_id") % 11 == 0, 2).otherwise(0)
    )
    month = year_month("ts")
    invalid_date = F.col("event_type") == "purchase"
    return e.select(
        F.col("event_type").alias("job_name"),
        F.col("event_id").alias("execution_id"),
        F.col("user_id").cast("string").alias("correlation_id"),
        F.col("ts").alias("start_time"),
        F.when(~open_run, F.timestamp_add("MILLISECOND", F.round(F.col("value") * 1000).cast("long"), F.col("ts"))).alias("end_time"),
        exit_code.alias("exit_code"),
        F.array(F.concat(F.lit("month="), month), F.concat(F.lit("user="), F.col("user_id").cast("string"))).alias("arguments"),
        F.when(exit_code == 1, F.when(invalid_date, "sales.report.job.invalid.date").otherwise("spark.unknown.error")).alias("error_code"),
        F.when((exit_code == 1) & ~invalid_date, F.concat(F.lit("exit code "), exit_code.cast("string"))).alias("error_cause"),
        F.when(invalid_date, F.array(month, F.col("event_type"))).otherwise(F.array().cast("array<string>")).alias("error_args"),
    )


def stop_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop requests: the correlation id of every error event."""
    return table(spark, sf_dir, "events").where(F.col("event_type") == "error").select(
        F.col("user_id").cast("string").alias("correlation_id")
    )


RUNS_SQL = """
SELECT event_type AS job_name, event_id AS execution_id, CAST(user_id AS VARCHAR) AS correlation_id,
  ts AS start_time,
  CASE WHEN event_id % 10 = 0 THEN NULL
       ELSE ts + to_milliseconds(CAST(round(value * 1000) AS BIGINT)) END AS end_time,
  CASE WHEN event_id % 7 = 0 THEN 1 WHEN event_id % 11 = 0 THEN 2 ELSE 0 END AS exit_code,
  strftime(ts, '%Y-%m') AS run_month,
  CASE WHEN event_id % 7 = 0 THEN
    CASE WHEN event_type = 'purchase' THEN 'sales.report.job.invalid.date' ELSE 'spark.unknown.error' END
  END AS error_code
FROM events
"""
