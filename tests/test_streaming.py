"""Streaming: restart from checkpoint, replayed batches, stopping a group, output modes."""

from __future__ import annotations

import os

import pytest
from pyspark.errors import StreamingQueryException

from tidewater.streaming.error_stream import file_log_source, start_error_job
from tidewater.streaming.launcher import QueryGroup, run_with_restart
from tidewater.streaming.sinks import foreach_batch_sink, idempotent_table_writer, output_mode

GOOD = "2024-11-01T10:00:00.000Z ERROR 1 --- [AppOne] [  t] c     : boom {}"
INFO = "2024-11-01T10:00:00.000Z INFO 1 --- [AppOne] [  t] c     : fine"


def _land(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_restart_resumes_without_duplicates(spark, tmp_dir):
    landing, table, ckpt = (os.path.join(tmp_dir, d) for d in ("in", "out", "ckpt"))
    _land(landing, "a.txt", [GOOD.format(i) for i in range(3)] + [INFO])

    def start():
        return start_error_job(
            file_log_source(spark, landing, 1),
            lambda df: foreach_batch_sink(df, idempotent_table_writer(table), ckpt),
            available_now=True,
        )

    run_with_restart(start, max_attempts=2, delay_s=0)
    assert spark.read.parquet(table).count() == 3
    _land(landing, "b.txt", [GOOD.format(i) for i in range(3, 5)])
    run_with_restart(start, max_attempts=2, delay_s=0)  # new file only
    run_with_restart(start, max_attempts=2, delay_s=0)  # nothing new
    out = spark.read.parquet(table)
    assert out.count() == 5
    assert out.select("batch_id").distinct().count() == 2


def test_replayed_batch_overwrites(spark, tmp_dir):
    body = idempotent_table_writer(os.path.join(tmp_dir, "t"))
    batch = spark.createDataFrame([("x",), ("y",)], "v STRING")
    body(batch, 0)
    body(batch, 1)
    body(batch, 1)  # replay after a failure
    assert spark.read.parquet(os.path.join(tmp_dir, "t")).count() == 4


def test_two_streams_and_a_new_checkpoint_keep_apart(spark, tmp_dir):
    table = os.path.join(tmp_dir, "out")
    landings = [os.path.join(tmp_dir, d) for d in ("in1", "in2")]
    for i, landing in enumerate(landings):
        _land(landing, "a.txt", [GOOD.format(i)])

    def run(landing, checkpoint):
        return run_with_restart(
            lambda: start_error_job(
                file_log_source(spark, landing),
                lambda df: foreach_batch_sink(df, idempotent_table_writer(table), os.path.join(tmp_dir, checkpoint)),
                available_now=True,
            ),
            max_attempts=1,
            delay_s=0,
        )

    run(landings[0], "ck1")
    run(landings[1], "ck2")  # another stream, also its batch 0
    assert spark.read.parquet(table).count() == 2
    run(landings[0], "ck3")  # a new checkpoint reads the file again, as its own batch 0
    out = spark.read.parquet(table)
    assert out.count() == 3
    assert out.select("stream_id").distinct().count() == 3
    assert not out.filter("stream_id = 'manual'").count()  # the id of the query, not the fallback


def test_restart_loop_gives_up_after_limit(spark):
    attempts = []

    def start():
        q = spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(
            lambda df, i: (_ for _ in ()).throw(RuntimeError("sink down"))
        ).start()
        return q

    with pytest.raises(StreamingQueryException):
        run_with_restart(start, max_attempts=2, delay_s=0, timeout_s=60, on_failure=lambda n, e: attempts.append(n))
    assert attempts == [1, 2]


def test_group_stops_all(spark):
    group = QueryGroup()
    for i in range(2):
        group.add(
            spark.readStream.format("rate").load().writeStream.format("noop").queryName(f"g{i}").start()
        )
    assert group.stop_all() == []
    assert all(not q.isActive for q in group.queries)


def test_output_modes():
    assert output_mode("Complete") == "complete"
    with pytest.raises(ValueError):
        output_mode("upsert")


def test_memory_and_console_sinks(spark, tmp_dir, capsys):
    from tidewater.functions.logs import parse_error_lines
    from tidewater.streaming.sinks import console_sink, memory_sink

    landing = os.path.join(tmp_dir, "in")
    _land(landing, "a.txt", [GOOD.format(1), INFO])
    errors = file_log_source(spark, landing).transform(parse_error_lines)
    q = memory_sink(errors, "errors_mem").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT * FROM errors_mem").count() == 1
    c = console_sink(errors).trigger(availableNow=True).start()
    c.awaitTermination()


def test_stop_requests_stream(spark, tmp_dir):
    import datetime as dt

    from tidewater.streaming.sinks import foreach_batch_sink
    from tidewater.streaming.stop_requests import stop_matcher, stop_request_source

    runs = spark.createDataFrame(
        [("j", 1, "c1", dt.datetime(2024, 1, 1), None), ("j", 2, "c1", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)),
         ("j", 3, "c2", dt.datetime(2024, 1, 1), None)],
        "job_name STRING, execution_id BIGINT, correlation_id STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ",
    )
    landing, table, ckpt = (os.path.join(tmp_dir, d) for d in ("in", "out", "ckpt"))
    _land(landing, "a.txt", ["c1", " c1 ", "zz"])
    _land(landing, "b.txt", ["c2", "c1"])
    q = foreach_batch_sink(stop_request_source(spark, landing, 1), stop_matcher(lambda: runs, table), ckpt).trigger(
        availableNow=True
    ).start()
    q.awaitTermination()
    # Files of equal age may be taken in either order: check per batch, not by position.
    rows = spark.read.parquet(table).collect()
    per_batch = sorted(sorted(r.execution_id for r in rows if r.batch_id == b) for b in (0, 1))
    assert per_batch == [[1], [1, 3]]


def test_file_source_archives_processed_files(spark, tmp_dir):
    from tidewater.sources import files as fs

    landing, archive, out, ckpt = (os.path.join(tmp_dir, d) for d in ("in", "arch", "out", "ck"))
    _land(landing, "a.txt", [GOOD.format(1)])
    src = fs.read_stream(spark, fs.FileOptions(path=landing, format="text"), clean_source="archive", archive_dir=archive)
    q = src.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(
        availableNow=True
    ).start()
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 1
    with pytest.raises(ValueError):
        fs.read_stream(spark, fs.FileOptions(path=landing, format="text"), clean_source="archive")


def test_update_mode_emits_changed_counts(spark, tmp_dir):
    from tidewater.plans.error_logs import error_counts
    from tidewater.streaming.error_stream import error_stream

    landing, ckpt = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "ck")
    _land(landing, "a.txt", [GOOD.format(1), GOOD.format(2).replace("AppOne", "AppTwo")])
    emitted = []

    def body(df, batch_id):
        emitted.append(sorted((r.application, r.error_count) for r in df.collect()))

    counts = error_counts(error_stream(file_log_source(spark, landing, 1)))

    def run_once():
        q = foreach_batch_sink(counts, body, ckpt, mode="update").trigger(availableNow=True).start()
        q.awaitTermination()

    run_once()
    _land(landing, "b.txt", [GOOD.format(3)])
    run_once()
    # the second batch re-emits only the application whose count changed
    assert emitted == [[("AppOne", 1), ("AppTwo", 1)], [("AppOne", 2)]]


def test_stop_request_stops_the_group(spark, tmp_dir):
    from tidewater.streaming.stop_requests import stop_request_source, stop_when_requested

    group = QueryGroup()
    group.add(spark.readStream.format("rate").load().writeStream.format("noop").start())
    landing = os.path.join(tmp_dir, "stops")
    _land(landing, "a.txt", ["other-job"])
    watcher = stop_when_requested(stop_request_source(spark, landing), "job-42", group, os.path.join(tmp_dir, "ck"))
    watcher.trigger(availableNow=True).start().awaitTermination()
    assert group.queries[0].isActive  # another id: ignored
    _land(landing, "b.txt", [" job-42 "])
    watcher.trigger(availableNow=True).start().awaitTermination()
    assert not group.queries[0].isActive
