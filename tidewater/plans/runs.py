"""Run history as a table: status, duration, messages, counts, latest runs,
pages and stop matching (C12-C16, D10, D11, E02-E06, F01, F02, F05-F07, I24).

The reference answers these per REST call against its task store; here they
are DataFrame operators over a ``runs`` table, so they scale with the history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.duration import duration_ms, duration_text
from tidewater.functions.text import fill_positional, problem_reason
from tidewater.operators.latest import latest_per_group, top_one
from tidewater.operators.paging import page, page_facts, page_summary
from tidewater.operators.rank_index import RankIndex, build_rank_index

# Run states, exit messages and exit codes of the task lifecycle.
RUNNING, SUCCESSFUL, FAILED = "RUNNING", "SUCCESSFUL", "FAILED"
EXIT_COMPLETED, EXIT_FAILED, EXIT_STOPPED = 0, 1, 2
MSG_RUNNING, MSG_COMPLETED, MSG_FAILED, MSG_TERMINATED = "Running", "Completed", "Failed", "Terminated"

# Error types (code, default title, default message) and the
# message-file overrides, keyed by code.
ERROR_TYPES: dict[str, tuple[str, str]] = {
    "sales.report.job.invalid.date": ("Invalid Request", "Job date: {0}, {1} can not be in future"),
    "spark.unknown.error": ("Spark Error", "Something went wrong in Spark pipeline"),
}
MESSAGE_OVERRIDES: dict[str, tuple[str, str]] = {
    "sales.report.job.invalid.date": ("My custom title", "My custom message, check param: {0}, {1}"),
}

# Newest first, execution id as the unique tie-breaker.
HISTORY_ORDER = ("start_time", "execution_id")


def run_status(end_time: Column, exit_code: Column) -> Column:
    """No end -> RUNNING; exit 0 -> SUCCESSFUL; else FAILED (C14)."""
    return F.when(end_time.isNull(), RUNNING).when(exit_code == 0, SUCCESSFUL).otherwise(FAILED)


def exit_message(end_time: Column, exit_code: Column) -> Column:
    """Running / Terminated (stopped) / Completed / Failed.

    Other exit codes keep the message set at start, ``Running``.
    """
    return (
        F.when(end_time.isNull(), MSG_RUNNING)
        .when(exit_code == EXIT_STOPPED, MSG_TERMINATED)
        .when(exit_code == EXIT_COMPLETED, MSG_COMPLETED)
        .when(exit_code == EXIT_FAILED, MSG_FAILED)
        .otherwise(MSG_RUNNING)
    )


def _map_literal(entries: Mapping[str, str]) -> Column:
    flat: list[Column] = []
    for k, v in entries.items():
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)


def message_lookup(
    code: Column,
    args: Column,
    error_types: Mapping[str, tuple[str, str]] = ERROR_TYPES,
    overrides: Mapping[str, tuple[str, str]] = MESSAGE_OVERRIDES,
) -> tuple[Column, Column]:
    """(title, message) for an error code: override first, else the type's default.

    The tables are a handful of fixed entries, so they travel inside the plan
    as map literals: a projection, no join and no shuffle.  ``{n}`` slots of
    the message are filled from ``args``.
    """
    default_title = _map_literal({k: v[0] for k, v in error_types.items()})[code]
    default_msg = _map_literal({k: v[1] for k, v in error_types.items()})[code]
    title = F.coalesce(_map_literal({k: v[0] for k, v in overrides.items()})[code], default_title)
    template = F.coalesce(_map_literal({k: v[1] for k, v in overrides.items()})[code], default_msg)
    slots = max([_slot_count(v[1]) for v in (*error_types.values(), *overrides.values())] + [0])
    message = fill_positional(template, [F.get(args, i) for i in range(slots)])
    return title, message


def _slot_count(template: str) -> int:
    n = 0
    while "{" + str(n) + "}" in template:
        n += 1
    return n


def job_executions(runs: DataFrame) -> DataFrame:
    """Run record projection (C16): status, duration text (NULL while running),
    exit message and error reason (I24).

    The millisecond span is computed once in its own projection; the text is
    then built from that column.
    """
    end, code = F.col("end_time"), F.col("exit_code")
    with_ms = runs.withColumn("_duration_ms", duration_ms(F.col("start_time"), end))
    if "error_message" in runs.columns:
        # A store that keeps the formatted text (a task store) is taken as it is.
        error_text = F.col("error_message")
    else:
        title, message = message_lookup(F.col("error_code"), F.col("error_args"))
        reason = problem_reason(F.col("error_code"), title, message, F.col("error_cause"), F.col("error_args"))
        failed = end.isNotNull() & (code == EXIT_FAILED) & F.col("error_code").isNotNull()
        error_text = F.when(failed, reason)
    return with_ms.select(
        "job_name",
        "execution_id",
        "correlation_id",
        run_status(end, code).alias("status"),
        "start_time",
        "end_time",
        duration_text("_duration_ms").alias("duration"),
        exit_message(end, code).alias("exit_message"),
        error_text.alias("error_message"),
        "arguments",
    )


def runs_by_job(runs: DataFrame, job_name: str) -> DataFrame:
    """Runs of one job."""
    return runs.filter(F.col("job_name") == job_name)


def runs_by_correlation(runs: DataFrame, correlation_id: str) -> DataFrame:
    """Runs of one correlation id."""
    return runs.filter(F.col("correlation_id") == correlation_id)


def running(runs: DataFrame, job_name: str | None = None) -> DataFrame:
    """Open runs (no end time), optionally of one job."""
    out = runs.filter(F.col("end_time").isNull())
    return out if job_name is None else runs_by_job(out, job_name)


def count_runs(runs: DataFrame) -> DataFrame:
    """Count of all runs and of running ones in one pass."""
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(F.col("end_time").isNull()).alias("running_runs"),
    )


def count_by(runs: DataFrame, key: str) -> DataFrame:
    """Runs per job name / correlation id."""
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("run_count"))


def job_names(runs: DataFrame) -> DataFrame:
    """Distinct job names (E06); a partial aggregate per task first."""
    return runs.select("job_name").distinct()


def latest_run(runs: DataFrame, job_name: str) -> DataFrame:
    """The newest run of a job; empty when there is none."""
    return top_one(runs_by_job(runs, job_name), HISTORY_ORDER)


def latest_runs(runs: DataFrame, names: Sequence[str]) -> DataFrame:
    """The newest run of each named job."""
    return latest_per_group(runs.filter(F.col("job_name").isin(list(names))), "job_name", HISTORY_ORDER, unique=True)


def parse_sort(sort: Sequence[str] | None) -> list[tuple[str, bool]]:
    """``["job_name", "start_time,desc"]`` -> keys; ascending by default.

    ``execution_id`` is appended as the unique last key so pages repeat.
    Without a sort the history is newest first.
    """
    if not sort:
        return [(k, False) for k in HISTORY_ORDER]
    keys: list[tuple[str, bool]] = []
    for item in sort:
        name, _, direction = item.partition(",")
        direction = direction.strip().lower() or "asc"
        if direction not in ("asc", "desc"):
            raise ValueError(f"sort direction must be asc or desc: {item!r}")
        keys.append((name.strip(), direction == "asc"))
    if "execution_id" not in [k for k, _ in keys]:
        keys.append(("execution_id", True))
    return keys


def history_page(runs: DataFrame, number: int, size: int, sort: Sequence[str] | None = None) -> DataFrame:
    """One page of the history (F05): newest first, or by ``sort`` keys.

    Deep pages: ``history_index`` and ``indexed_page``, or a walk by ``operators.paging.page_after``.
    """
    return page(runs, number, size, parse_sort(sort))


def history_index(runs: DataFrame, sort: Sequence[str] | None = None, root: str | None = None) -> RankIndex:
    """The history in order with its record numbers, for pages at any depth."""
    return build_rank_index(runs, parse_sort(sort), root)


def numbered_history(index: RankIndex, size: int) -> DataFrame:
    """Every run with its record number (from 1), its page (from 0) and its place there (from 0)."""
    if size < 1:
        raise ValueError("a page holds one record at least")
    at = F.col("record_number") - 1
    return index.numbered("record_number").withColumns(
        {"page": ((at - at % size) / size).cast("long"), "place": (at % size).cast("int")}
    )


def indexed_page(index: RankIndex, number: int, size: int) -> DataFrame:
    """Page ``number`` (0-based) in order, with record numbers and the facts of the page envelope.

    Reads the ranges that the page overlaps; only the page itself is sorted.
    """
    facts = page_facts(F.lit(index.total), number, size)
    return index.page(number, size, "record_number").select("*", *facts).orderBy("record_number")


def history_page_facts(runs: DataFrame, number: int, size: int) -> DataFrame:
    return page_summary(runs, number, size)


def match_stop_requests(runs: DataFrame, stops: DataFrame, key: str = "correlation_id") -> DataFrame:
    """Open runs named by a stop request; exact key equality.

    Requests are de-duplicated first (map-side partial aggregate), then a
    left-semi join: each run appears once however many requests name it.
    AQE splits a skewed key partition of ``runs``.
    """
    requests = stops.select(key).where(F.col(key).isNotNull()).distinct()
    return running(runs).join(requests, key, "left_semi")
