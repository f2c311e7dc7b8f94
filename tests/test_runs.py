"""Run-history semantics on hand-made runs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewater.plans import runs as R

DDL = (
    "job_name STRING, execution_id BIGINT, correlation_id STRING, start_time TIMESTAMP_NTZ, "
    "end_time TIMESTAMP_NTZ, exit_code INT, arguments ARRAY<STRING>, error_code STRING, "
    "error_cause STRING, error_args ARRAY<STRING>"
)
T0 = dt.datetime(2024, 11, 1, 10, 0, 0)


def _runs(spark):
    rows = [
        ("sales", 1, "c1", T0, None, None, [], None, None, []),  # running
        ("sales", 2, "c1", T0, T0, 0, ["a"], None, None, []),  # duration 0
        ("sales", 3, "c2", T0, T0 + dt.timedelta(hours=3, minutes=34, seconds=23, milliseconds=113), 0, [], None, None, []),
        ("sales", 4, "c2", T0, T0 + dt.timedelta(seconds=5), 1, [],
         "sales.report.job.invalid.date", None, ["2024-12", "IST"]),  # no millis, failed with known code
        ("logs", 5, "c3", T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=1, minutes=1), 2, [], None, None, []),
        ("logs", 6, "c3", T0, T0 + dt.timedelta(milliseconds=7), 1, [], "spark.unknown.error", "boom", []),
        ("logs", 7, "c4", T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=1), 3, [], None, None, []),
    ]
    return spark.createDataFrame(rows, DDL)


def test_status_duration_messages(spark):
    ex = {r.execution_id: r for r in R.job_executions(_runs(spark)).collect()}
    assert ex[1].status == "RUNNING" and ex[1].duration is None and ex[1].exit_message == "Running"
    assert ex[2].status == "SUCCESSFUL" and ex[2].duration == "" and ex[2].exit_message == "Completed"
    assert ex[3].duration == "3 Hours 34 Minutes 23 Seconds 113 Milli Seconds"
    assert ex[4].duration == "5 Seconds " and ex[4].status == "FAILED" and ex[4].exit_message == "Failed"
    assert ex[5].exit_message == "Terminated" and ex[5].status == "FAILED"
    assert ex[7].exit_message == "Running" and ex[7].status == "FAILED"
    assert ex[4].error_message == (
        "code: sales.report.job.invalid.date, title: My custom title, "
        "message: My custom message, check param: 2024-12, IST, cause: , args: {2024-12,IST}"
    )
    assert ex[6].error_message == (
        "code: spark.unknown.error, title: Spark Error, message: Something went wrong in Spark pipeline, "
        "cause: boom, args: "
    )
    assert ex[2].error_message is None


def test_counts_and_names(spark):
    runs = _runs(spark)
    c = R.count_runs(runs).first()
    assert (c.total_runs, c.running_runs) == (7, 1)
    by_job = {r.job_name: r.run_count for r in R.count_by(runs, "job_name").collect()}
    assert by_job == {"sales": 4, "logs": 3}
    assert sorted(r.job_name for r in R.job_names(runs).collect()) == ["logs", "sales"]
    assert [r.execution_id for r in R.running(runs, "sales").collect()] == [1]


def test_latest(spark):
    runs = _runs(spark)
    assert [r.execution_id for r in R.latest_run(runs, "logs").collect()] == [7]
    assert R.latest_run(runs, "nope").count() == 0
    latest = {r.job_name: r.execution_id for r in R.latest_runs(runs, ["sales", "logs", "nope"]).collect()}
    assert latest == {"sales": 4, "logs": 7}


def test_paging(spark):
    runs = _runs(spark)
    ids = [r.execution_id for r in R.history_page(runs, 0, 3).collect()]
    assert ids == [7, 5, 6]
    assert [r.execution_id for r in R.history_page(runs, 2, 3).collect()] == [1]
    f = R.history_page_facts(runs, 2, 3).first()
    assert (f.total_pages, f.has_next, f.has_previous, f.is_first, f.is_last) == (3, False, True, False, True)
    assert f.header == "Page 3 of 3" and f.first_result == 6 and f.max_results == 3
    empty = R.history_page_facts(runs.limit(0), 0, 10).first()
    assert empty.header == "Page 0 of 0" and empty.total_pages == 0
    zero = R.history_page_facts(runs, 0, 0).first()
    assert zero.total_pages == 0


def test_keyset_page_matches_offset_page(spark):
    from tidewater.operators.paging import page_after

    runs = _runs(spark)
    keys = [("start_time", False), ("execution_id", False)]
    first = R.history_page(runs, 0, 3).collect()
    last = (first[-1].start_time, first[-1].execution_id)
    nxt = [r.execution_id for r in page_after(runs, 3, keys, last).collect()]
    assert nxt == [r.execution_id for r in R.history_page(runs, 1, 3).collect()]


def test_stop_match_only_open_runs(spark):
    runs = _runs(spark)
    stops = spark.createDataFrame([("c1",), ("c1",), ("c2",), ("zz",), (None,)], "correlation_id STRING")
    assert [r.execution_id for r in R.match_stop_requests(runs, stops).collect()] == [1]


def test_keyset_paging_walks_the_whole_history(spark):
    from tidewater.operators.paging import page_after
    from tidewater.plans import views

    runs = views.runs(spark, "/root/testdata/sf0.001").select("execution_id", "start_time")
    keys = [("start_time", False), ("execution_id", False)]
    expected = [r.execution_id for r in runs.orderBy(F.col("start_time").desc(), F.col("execution_id").desc()).collect()]
    seen, last = [], None
    while True:
        page_rows = page_after(runs, 250, keys, last).collect()
        if not page_rows:
            break
        seen += [r.execution_id for r in page_rows]
        last = (page_rows[-1].start_time, page_rows[-1].execution_id)
    assert seen == expected


def test_parse_sort():
    assert R.parse_sort(None) == [("start_time", False), ("execution_id", False)]
    assert R.parse_sort(["job_name", "start_time,desc"]) == [("job_name", True), ("start_time", False), ("execution_id", True)]
    assert R.parse_sort(["execution_id,desc"]) == [("execution_id", False)]
    import pytest

    with pytest.raises(ValueError):
        R.parse_sort(["job_name,sideways"])


def test_deep_pages_are_served(spark):
    from tidewater.operators.paging import page

    df = spark.range(250_000).withColumnRenamed("id", "k")
    assert [r.k for r in page(df, 20_000, 10, [("k", True)]).orderBy("k").collect()] == list(range(200_000, 200_010))



def test_keyset_paging_in_a_non_utc_session(spark):
    from tidewater.operators.paging import page_after
    from tidewater.plans import views

    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        runs = views.runs(spark, "/root/testdata/sf0.001").select("execution_id", "start_time")
        keys = [("start_time", False), ("execution_id", False)]
        first = page_after(runs, 100, keys, None).collect()
        nxt = page_after(runs, 100, keys, (first[-1].start_time, first[-1].execution_id)).collect()
        expected = [r.execution_id for r in R.history_page(runs, 1, 100).collect()]
        assert [r.execution_id for r in nxt] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
