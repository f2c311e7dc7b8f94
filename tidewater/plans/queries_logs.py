"""Registered log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.logs import ERROR_LINE_PATTERN
from tidewater.plans import views
from tidewater.plans.error_logs import error_counts, extract_errors
from tidewater.plans.registry import register

# DuckDB's RE2 has no look-behind; a look-behind on ``^`` means "at the start",
# which RE2 writes as ``^``.
_RE2_PATTERN = ERROR_LINE_PATTERN.replace("(?<=^)", "^", 1)
PARSE_SQL = f"""
WITH lines AS ({views.LOG_LINES_SQL})
SELECT regexp_extract(log_line, '{_RE2_PATTERN}', 1) AS datetime,
       regexp_extract(log_line, '{_RE2_PATTERN}', 3) AS application,
       regexp_extract(log_line, '{_RE2_PATTERN}', 4) AS error_message
FROM lines WHERE regexp_matches(log_line, '{_RE2_PATTERN}')
"""


@register("log_render", "I25", f"SELECT event_id, log_line FROM ({views.LOG_LINES_SQL})")
def q_log_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.log_lines(spark, sf_dir, with_id=True)


@register("log_parse_errors", "C02 C06 C07 J08", PARSE_SQL)
def q_log_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Lines travel as a binary payload, as they do from a message queue.
    raw = views.log_lines(spark, sf_dir).select(F.col("log_line").cast("binary").alias("value"))
    return extract_errors(raw, payload_column="value")


@register(
    "log_error_counts",
    "C02 C07",
    f"SELECT application, count(*) AS error_count FROM ({PARSE_SQL}) GROUP BY application",
)
def q_log_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_counts(extract_errors(views.log_lines(spark, sf_dir)))
