"""Registered run-history queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.duration import compose_ms, duration_ms, duration_parts, duration_text
from tidewater.plans import runs as R
from tidewater.plans import views
from tidewater.plans.registry import register

JOB = "purchase"
CORRELATION = "42"
LATEST_JOBS = ("purchase", "error", "click")
PAGE, PAGE_SIZE = 3, 10

_DUR_MS = "((epoch_us(end_time) - epoch_us(start_time)) // 1000)"
_DURATION_TEXT_SQL = f"""
  CASE WHEN end_time IS NULL THEN NULL ELSE
    CASE WHEN {_DUR_MS} // 3600000 <> 0 THEN CAST({_DUR_MS} // 3600000 AS VARCHAR) || ' Hours ' ELSE '' END
 || CASE WHEN ({_DUR_MS} % 3600000) // 60000 <> 0 THEN CAST(({_DUR_MS} % 3600000) // 60000 AS VARCHAR) || ' Minutes ' ELSE '' END
 || CASE WHEN ({_DUR_MS} % 60000) // 1000 <> 0 THEN CAST(({_DUR_MS} % 60000) // 1000 AS VARCHAR) || ' Seconds ' ELSE '' END
 || CASE WHEN {_DUR_MS} % 1000 <> 0 THEN CAST({_DUR_MS} % 1000 AS VARCHAR) || ' Milli Seconds' ELSE '' END
  END"""
_ERROR_TEXT_SQL = """
  CASE WHEN end_time IS NOT NULL AND exit_code = 1 AND error_code IS NOT NULL THEN
    'code: ' || error_code
    || ', title: ' || CASE error_code WHEN 'sales.report.job.invalid.date' THEN 'My custom title' ELSE 'Spark Error' END
    || ', message: ' || CASE error_code
         WHEN 'sales.report.job.invalid.date'
         THEN replace(replace('My custom message, check param: {0}, {1}', '{0}', run_month), '{1}', job_name)
         ELSE 'Something went wrong in Spark pipeline' END
    || ', cause: ' || CASE WHEN error_code = 'spark.unknown.error' THEN 'exit code 1' ELSE '' END
    || ', args: ' || CASE WHEN error_code = 'sales.report.job.invalid.date' THEN '{' || run_month || ',' || job_name || '}' ELSE '' END
  END"""
RUNS_VIEW_SQL = f"""
WITH runs AS ({views.RUNS_SQL})
SELECT job_name, execution_id, correlation_id,
  CASE WHEN end_time IS NULL THEN 'RUNNING' WHEN exit_code = 0 THEN 'SUCCESSFUL' ELSE 'FAILED' END AS status,
  start_time, end_time,
  {_DURATION_TEXT_SQL} AS duration,
  CASE WHEN end_time IS NULL THEN 'Running' WHEN exit_code = 2 THEN 'Terminated'
       WHEN exit_code = 0 THEN 'Completed' WHEN exit_code = 1 THEN 'Failed' ELSE 'Running' END AS exit_message,
  {_ERROR_TEXT_SQL} AS error_message
FROM runs
"""
_RUNS = f"WITH runs AS ({views.RUNS_SQL})"
_BASE_COLS = "job_name, execution_id, correlation_id, start_time, end_time, exit_code"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.runs(spark, sf_dir)


def _base(df: DataFrame) -> DataFrame:
    return df.select(*_BASE_COLS.split(", "))


@register("runs_view", "C14 C15 C16 I15 I16 I24 D11", RUNS_VIEW_SQL)
def q_runs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.job_executions(_runs(spark, sf_dir)).drop("arguments")


@register(
    "runs_error_text",
    "D11 I24",
    f"SELECT execution_id, error_message FROM ({RUNS_VIEW_SQL}) WHERE error_message IS NOT NULL",
)
def q_runs_error_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = R.job_executions(_runs(spark, sf_dir))
    return ex.where(F.col("error_message").isNotNull()).select("execution_id", "error_message")


@register("runs_by_job", "C12", f"{_RUNS} SELECT {_BASE_COLS} FROM runs WHERE job_name = '{JOB}'")
def q_runs_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(R.runs_by_job(_runs(spark, sf_dir), JOB))


@register(
    "runs_by_correlation",
    "C12",
    f"{_RUNS} SELECT {_BASE_COLS} FROM runs WHERE correlation_id = '{CORRELATION}'",
)
def q_runs_by_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(R.runs_by_correlation(_runs(spark, sf_dir), CORRELATION))


@register(
    "runs_running",
    "C13",
    f"{_RUNS} SELECT {_BASE_COLS} FROM runs WHERE end_time IS NULL AND job_name = '{JOB}'",
)
def q_runs_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(R.running(_runs(spark, sf_dir), JOB))


@register(
    "runs_count",
    "E02 E03",
    f"{_RUNS} SELECT count(*) AS total_runs, count(*) FILTER (WHERE end_time IS NULL) AS running_runs FROM runs",
)
def q_runs_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.count_runs(_runs(spark, sf_dir))


@register(
    "runs_count_running",
    "E03",
    f"{_RUNS} SELECT job_name, count(*) AS run_count FROM runs WHERE end_time IS NULL GROUP BY job_name",
)
def q_runs_count_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.count_by(R.running(_runs(spark, sf_dir)), "job_name")


@register(
    "runs_count_by_job",
    "E04",
    f"{_RUNS} SELECT job_name, count(*) AS run_count FROM runs GROUP BY job_name",
)
def q_runs_count_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.count_by(_runs(spark, sf_dir), "job_name")


@register(
    "runs_count_by_correlation",
    "E05",
    f"{_RUNS} SELECT correlation_id, count(*) AS run_count FROM runs GROUP BY correlation_id",
)
def q_runs_count_by_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.count_by(_runs(spark, sf_dir), "correlation_id")


@register("runs_job_names", "E06", f"{_RUNS} SELECT DISTINCT job_name FROM runs")
def q_runs_job_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.job_names(_runs(spark, sf_dir))


@register(
    "runs_latest_one",
    "F01 F04",
    f"""{_RUNS} SELECT {_BASE_COLS} FROM runs WHERE job_name = '{JOB}'
ORDER BY start_time DESC, execution_id DESC LIMIT 1""",
)
def q_runs_latest_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(R.latest_run(_runs(spark, sf_dir), JOB))


@register(
    "runs_latest_per_job",
    "F02",
    f"""{_RUNS} SELECT {_BASE_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY job_name ORDER BY start_time DESC, execution_id DESC) AS rn
  FROM runs WHERE job_name IN ({", ".join(f"'{j}'" for j in LATEST_JOBS)})) WHERE rn = 1""",
)
def q_runs_latest_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(R.latest_runs(_base(_runs(spark, sf_dir)), LATEST_JOBS))


@register(
    "runs_page",
    "F05",
    f"""{_RUNS} SELECT {_BASE_COLS} FROM runs ORDER BY start_time DESC, execution_id DESC
LIMIT {PAGE_SIZE} OFFSET {PAGE * PAGE_SIZE}""",
)
def q_runs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(R.history_page(_runs(spark, sf_dir), PAGE, PAGE_SIZE))


@register(
    "runs_page_sorted",
    "F05",
    f"""{_RUNS} SELECT {_BASE_COLS} FROM runs ORDER BY job_name ASC, start_time DESC, execution_id ASC
LIMIT {PAGE_SIZE} OFFSET {PAGE * PAGE_SIZE}""",
)
def q_runs_page_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(R.history_page(_runs(spark, sf_dir), PAGE, PAGE_SIZE, ["job_name", "start_time,desc"]))


@register(
    "runs_page_facts",
    "F06 F07",
    f"""{_RUNS}, t AS (SELECT count(*) AS n FROM runs)
SELECT n AS total_records, {PAGE} AS current_page, {PAGE_SIZE} AS page_size,
  CAST(ceil(n / {PAGE_SIZE}.0) AS INTEGER) AS total_pages,
  {PAGE} + 1 < CAST(ceil(n / {PAGE_SIZE}.0) AS INTEGER) AS has_next,
  {PAGE} > 0 AS has_previous, NOT ({PAGE} > 0) AS is_first,
  NOT ({PAGE} + 1 < CAST(ceil(n / {PAGE_SIZE}.0) AS INTEGER)) AS is_last,
  'Page ' || CASE WHEN n = 0 THEN 0 ELSE {PAGE} + 1 END || ' of ' || CAST(ceil(n / {PAGE_SIZE}.0) AS INTEGER) AS header,
  {PAGE * PAGE_SIZE} AS first_result, {PAGE_SIZE} AS max_results
FROM t""",
)
def q_runs_page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.history_page_facts(_runs(spark, sf_dir), PAGE, PAGE_SIZE)


_NUMBERED_SQL = f"""{_RUNS}, o AS (SELECT {_BASE_COLS}, row_number() OVER (ORDER BY start_time DESC, execution_id DESC) AS record_number,
  count(*) OVER () AS n FROM runs)"""


@register(
    "runs_record_numbers",
    "F05 F07",
    f"""{_NUMBERED_SQL} SELECT {_BASE_COLS}, record_number, (record_number - 1) // {PAGE_SIZE} AS page,
  CAST((record_number - 1) % {PAGE_SIZE} AS INTEGER) AS place FROM o""",
)
def q_runs_record_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run with its exact place in the sorted history."""
    return R.numbered_history(R.history_index(_base(_runs(spark, sf_dir))), PAGE_SIZE)


@register(
    "runs_page_middle",
    "F05 F06 F07",
    f"""{_NUMBERED_SQL}, p AS (SELECT *, (n // {PAGE_SIZE}) // 2 AS number, CAST(ceil(n / {PAGE_SIZE}.0) AS INTEGER) AS pages FROM o)
SELECT {_BASE_COLS}, record_number, n AS total_records, CAST(number AS INTEGER) AS current_page, {PAGE_SIZE} AS page_size, pages AS total_pages,
  number + 1 < pages AS has_next, number > 0 AS has_previous, number = 0 AS is_first, number + 1 >= pages AS is_last,
  'Page ' || (number + 1) || ' of ' || pages AS header, CAST(number * {PAGE_SIZE} AS INTEGER) AS first_result, {PAGE_SIZE} AS max_results
FROM p WHERE record_number > number * {PAGE_SIZE} AND record_number <= (number + 1) * {PAGE_SIZE}""",
)
def q_runs_page_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page in the middle of all runs, with its facts: reads the range or two it lies in."""
    index = R.history_index(_base(_runs(spark, sf_dir)))
    return R.indexed_page(index, (index.total // PAGE_SIZE) // 2, PAGE_SIZE)


@register(
    "runs_stop_match",
    "D10",
    f"""{_RUNS} SELECT {_BASE_COLS} FROM runs WHERE end_time IS NULL AND correlation_id IN
  (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'error')""",
)
def q_runs_stop_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(R.match_stop_requests(_runs(spark, sf_dir), views.stop_requests(spark, sf_dir)))


@register(
    "duration_parts",
    "I15 I16 I17",
    f"""{_RUNS}, d AS (SELECT execution_id, {_DUR_MS} AS duration_ms, start_time, end_time FROM runs WHERE end_time IS NOT NULL)
SELECT execution_id, duration_ms,
  duration_ms // 3600000 AS hours, (duration_ms % 3600000) // 60000 AS minutes,
  (duration_ms % 60000) // 1000 AS seconds, duration_ms % 1000 AS millis,
  {_DURATION_TEXT_SQL} AS duration_text,
  duration_ms AS recomposed_ms
FROM d""",
)
def q_duration_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = _runs(spark, sf_dir).where(F.col("end_time").isNotNull())
    ms = duration_ms("start_time", "end_time")
    with_ms = closed.select("execution_id", ms.alias("duration_ms"))
    parts = duration_parts("duration_ms")
    return with_ms.select(
        "execution_id",
        "duration_ms",
        *[v.alias(k) for k, v in parts.items()],
        duration_text("duration_ms").alias("duration_text"),
        compose_ms(parts["hours"], parts["minutes"], parts["seconds"], parts["millis"]).alias("recomposed_ms"),
    )
