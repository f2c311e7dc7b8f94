"""Runs from task-store tables, then the run-history operators on them."""

from __future__ import annotations

import datetime as dt

from tidewater.plans import runs as R
from tidewater.plans.task_store import runs_from_task_tables

T0 = dt.datetime(2024, 11, 1, 10)


def test_task_tables_to_runs(spark):
    executions = spark.createDataFrame(
        [
            (1, "sales-report", "c1", T0, T0 + dt.timedelta(seconds=2, milliseconds=5), 0, "Completed", None),
            (2, "sales-report", "c2", T0, None, None, "Running", None),
            (3, "log-analysis", "c3", T0, T0 + dt.timedelta(minutes=1), 1, "Failed", "code: x, title: t"),
        ],
        "TASK_EXECUTION_ID BIGINT, TASK_NAME STRING, EXTERNAL_EXECUTION_ID STRING, START_TIME TIMESTAMP, "
        "END_TIME TIMESTAMP, EXIT_CODE INT, EXIT_MESSAGE STRING, ERROR_MESSAGE STRING",
    )
    params = spark.createDataFrame([(1, "--month=2024-11"), (3, "--topic=logs")], "TASK_EXECUTION_ID BIGINT, TASK_PARAM STRING")
    runs = runs_from_task_tables(executions, params)
    ex = {r.execution_id: r for r in R.job_executions(runs).collect()}
    assert ex[1].status == "SUCCESSFUL" and ex[1].duration == "2 Seconds 5 Milli Seconds" and ex[1].arguments == ["--month=2024-11"]
    assert ex[2].status == "RUNNING" and ex[2].arguments == []
    assert ex[3].status == "FAILED" and ex[3].error_message == "code: x, title: t"
    # equal start times: the higher execution id is the latest
    assert [r.execution_id for r in R.latest_runs(runs.drop("arguments"), ["sales-report"]).collect()] == [2]
