"""Registered streaming queries (J01-J09, A15 by file, B12, B13, D10).

Each lands data derived from the whole ``events`` table (rendered log lines,
or stop requests) as text files below the shared checkpoint folder - the
stand-in for the topic - runs the stream over it with its own checkpoint,
and returns what the sink holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans import queries_runs, views
from tidewater.plans.error_logs import error_counts
from tidewater.plans.queries_logs import PARSE_SQL
from tidewater.plans.registry import register
from tidewater.session import scratch_path
from tidewater.sources import files
from tidewater.streaming.error_stream import error_stream, file_log_source, start_error_job
from tidewater.streaming.launcher import QueryGroup, run_with_restart, start_once
from tidewater.streaming.open_runs import run_event_source, run_events, stop_actions
from tidewater.streaming.sinks import SINK_COLUMNS, foreach_batch_sink, idempotent_table_writer, snapshot_writer
from tidewater.streaming.stop_requests import stop_request_source
from tidewater.streaming.upsert import read_upserted, upsert_writer

#: Source bytes of a micro-batch; whole files are taken, at least one.
BYTES_PER_TRIGGER = 1 << 30


def land_log_lines(spark: SparkSession, sf_dir: str) -> str:
    """Write every rendered line as text, in as many files as the scan has parts."""
    path = scratch_path(spark, "landing")
    views.log_lines(spark, sf_dir).write.text(path)
    return path


@register("log_stream_errors", "J01 J03 J04 J08 J09", PARSE_SQL)
def q_log_stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = land_log_lines(spark, sf_dir)
    table, checkpoint = scratch_path(spark, "error_logs"), scratch_path(spark, "checkpoint")

    def start():
        return start_error_job(
            file_log_source(spark, landing, max_bytes_per_trigger=BYTES_PER_TRIGGER),
            lambda df: foreach_batch_sink(df, idempotent_table_writer(table), checkpoint),
            available_now=True,
        )

    run_with_restart(start, max_attempts=3, delay_s=1.0)
    # A second start resumes from the checkpoint: nothing is read or written twice.
    run_with_restart(start, max_attempts=3, delay_s=1.0)
    return spark.read.parquet(table).drop(*SINK_COLUMNS)


@register("log_stream_recovery", "J03 J04 J09", PARSE_SQL)
def q_log_stream_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream stops between two deliveries and goes on from its checkpoint: nothing is lost or written twice."""
    landing, table, checkpoint = (scratch_path(spark, d) for d in ("landing", "error_logs", "checkpoint"))
    lines = views.log_lines(spark, sf_dir, with_id=True)

    def start():
        return start_error_job(
            file_log_source(spark, landing, max_bytes_per_trigger=BYTES_PER_TRIGGER),
            lambda df: foreach_batch_sink(df, idempotent_table_writer(table), checkpoint),
            available_now=True,
        )

    for part in (0, 1):
        lines.where(F.col("event_id") % 2 == part).select("log_line").write.mode("append").text(landing)
        run_with_restart(start, max_attempts=3, delay_s=0.5)
    return spark.read.parquet(table).drop(*SINK_COLUMNS)


@register("log_stream_file_sink", "B12 J02 J03 J05", PARSE_SQL)
def q_log_stream_file_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = land_log_lines(spark, sf_dir)
    out = files.FileOptions(path=scratch_path(spark, "error_files"), format="parquet")
    checkpoint = scratch_path(spark, "checkpoint")
    q = start_once(
        lambda: start_error_job(
            file_log_source(spark, landing, max_bytes_per_trigger=BYTES_PER_TRIGGER),
            lambda df: files.write_stream(df, out, checkpoint),
            available_now=True,
        )
    )
    if q is None:
        raise RuntimeError("file-sink stream failed")
    return files.read(spark, out)


@register(
    "stream_multi_query_stop",
    "J02 J06",
    f"SELECT application, count(*) AS error_count FROM ({PARSE_SQL}) GROUP BY application",
)
def q_stream_multi_query_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries on one source: rows to files (append) and counts per
    application (complete mode, state bounded by the number of applications);
    then both are stopped together."""
    landing = land_log_lines(spark, sf_dir)
    counts_path = scratch_path(spark, "error_counts")
    group = QueryGroup()
    rows = start_error_job(
        file_log_source(spark, landing, max_bytes_per_trigger=BYTES_PER_TRIGGER),
        lambda df: files.write_stream(
            df, files.FileOptions(path=scratch_path(spark, "rows")), scratch_path(spark, "checkpoint")
        ),
        available_now=True,
    )
    counts_stream = error_counts(error_stream(file_log_source(spark, landing, max_bytes_per_trigger=BYTES_PER_TRIGGER)))
    counts = (
        foreach_batch_sink(counts_stream, snapshot_writer(counts_path), scratch_path(spark, "checkpoint"), "complete")
        .trigger(processingTime="0 seconds")
        .start()
    )
    group.add(rows, counts)
    try:
        rows.awaitTermination()
        counts.processAllAvailable()
    finally:
        # Whatever happened, no query of this group is left running.
        errors = group.stop_all()
    if errors:
        raise RuntimeError(f"queries failed to stop: {errors}")
    return spark.read.parquet(counts_path)


@register(
    "stream_upsert_counts",
    "E01 J01 J02 J03",
    f"SELECT application, count(*) AS error_count FROM ({PARSE_SQL}) GROUP BY application",
)
def q_stream_upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per application kept in a table by update mode: each micro-batch replaces the rows of the counts it changed.

    The lines arrive in two deliveries, so the second run changes counts that
    the first has written.
    """
    landing, table, checkpoint = (scratch_path(spark, d) for d in ("landing", "error_counts", "checkpoint"))
    lines = views.log_lines(spark, sf_dir, with_id=True)
    schema = None
    for part in (0, 1):
        lines.where(F.col("event_id") % 2 == part).select("log_line").write.mode("append").text(landing)
        counts = error_counts(error_stream(file_log_source(spark, landing, max_bytes_per_trigger=BYTES_PER_TRIGGER)))
        schema = counts.schema
        body = upsert_writer(table, ["application"], buckets=4)
        foreach_batch_sink(counts, body, checkpoint, "update").trigger(availableNow=True).start().awaitTermination()
    return read_upserted(spark, table, schema)


_STOP_SQL = f"""{queries_runs._RUNS} SELECT {queries_runs._BASE_COLS} FROM runs WHERE end_time IS NULL AND correlation_id IN
  (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'error')"""


@register("runs_stop_stream", "D10 J01 J03", _STOP_SQL)
def q_runs_stop_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and ends of runs, then stop requests, each as a stream: the runs to stop come out of the state of open runs.

    The stream stops after the history and goes on with the requests from its
    checkpoint; no micro-batch reads the history again, and a run that several
    requests name is named once.
    """
    history, asked, table, checkpoint = (scratch_path(spark, d) for d in ("run_events", "stop_requests", "stop_actions", "checkpoint"))
    columns = queries_runs._BASE_COLS.split(", ")
    events = run_events(views.runs(spark, sf_dir).select(*columns))
    events.write.parquet(history)
    requests = views.stop_requests(spark, sf_dir)
    requests.limit(0).write.text(asked)

    def start():
        actions = stop_actions(run_event_source(spark, history, events.schema), stop_request_source(spark, asked, max_bytes_per_trigger=BYTES_PER_TRIGGER))
        return foreach_batch_sink(actions, idempotent_table_writer(table), checkpoint).trigger(availableNow=True).start()

    run_with_restart(start, max_attempts=3, delay_s=0.5)
    requests.write.mode("append").text(asked)
    run_with_restart(start, max_attempts=3, delay_s=0.5)
    return spark.read.parquet(table).select(*columns)
