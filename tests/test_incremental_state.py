"""Stores that are refreshed in parts: daily sums, upserted results, the state of open runs, observed counts, latest rows."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tests.plan_utils import explain_text
from tidewater.operators.latest import latest_per_group
from tidewater.operators.quality import CountedOutputs
from tidewater.plans import views
from tidewater.plans.daily_store import DailyStore
from tidewater.plans.sales_report import monthly_sales_report
from tidewater.streaming.launcher import run_with_restart
from tidewater.streaming.open_runs import run_event_source, run_events, stop_actions
from tidewater.streaming.sinks import foreach_batch_sink, idempotent_table_writer
from tidewater.streaming.stop_requests import stop_request_source
from tidewater.streaming.upsert import read_upserted, upsert_writer

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- daily sums -----------------------------------------------------------


def test_a_month_loaded_in_parts_equals_the_one_pass_report(spark, tmp_dir):
    sales, products = views.sales(spark, SF), views.products(spark, SF)
    store = DailyStore(spark, tmp_dir)
    assert store.loaded_until() is None and store.read().count() == 0
    days = [dt.date(1998, 2, 27), dt.date(1998, 3, 3), dt.date(1998, 3, 3), dt.date(1998, 3, 20), dt.date(1998, 4, 2)]
    before = [store.load(sales, d)[0] for d in days]
    assert before == [None, *days[:1], *days[1:4]]
    for month in ("1998-02", "1998-03", "1997-12"):
        assert rows_of(store.report(products, month)) == rows_of(monthly_sales_report(sales, products, month))
    assert store.loads().count() == 4  # the repeated day added nothing


def test_a_refresh_scans_only_the_days_after_the_mark(spark, tmp_dir):
    store = DailyStore(spark, tmp_dir)
    seen = []
    store.load(views.sales(spark, SF), dt.date(1998, 3, 14))
    late = views.sales(spark, SF).withColumn("quantity", F.when(F.col("timestamp") < F.lit("1998-03-15").cast("timestamp_ntz"), F.raise_error(F.lit("old day"))).otherwise(F.col("quantity")))
    store.load(late, dt.date(1998, 3, 31))  # a row of an old day would fail the job
    seen = store.read("1998-03")
    folders = {os.path.basename(os.path.dirname(os.path.dirname(f))) for f in seen.inputFiles()}
    assert "month=1998-03" in folders
    assert rows_of(store.report(views.products(spark, SF), "1998-03")) == rows_of(
        monthly_sales_report(views.sales(spark, SF), views.products(spark, SF), "1998-03")
    )


def test_a_load_that_died_is_not_read(spark, tmp_dir):
    sales = views.sales(spark, SF)
    store = DailyStore(spark, tmp_dir)
    store.load(sales, dt.date(1998, 3, 14))
    # Sums without a committed load, as a driver that died before the commit leaves them.
    left = spark.createDataFrame([(1, 1e9, dt.date(1998, 3, 16), "1998-03", 2)], "product_id BIGINT, daily_sale_amount DOUBLE, sale_date DATE, month STRING, load INT")
    left.write.mode("append").partitionBy("month", "load").parquet(f"{tmp_dir}/sums")
    assert store.loaded_until() == dt.date(1998, 3, 14) and store.read().filter("daily_sale_amount = 1e9").count() == 0
    store.load(sales, dt.date(1998, 3, 31))
    assert rows_of(store.report(views.products(spark, SF), "1998-03")) == rows_of(
        monthly_sales_report(sales, views.products(spark, SF), "1998-03")
    )


# --- update mode ----------------------------------------------------------

PAIRS = "k STRING, n BIGINT"


def test_upsert_replaces_changed_keys_only(spark, tmp_dir):
    write = upsert_writer(tmp_dir, ["k"], buckets=4, keep_versions=2)
    schema = spark.createDataFrame([], PAIRS).schema
    assert read_upserted(spark, tmp_dir, schema).count() == 0
    model: dict = {}
    batches = [[("a", 1), ("b", 2), (None, 3)], [("b", 5), ("c", 6)], [], [("b", 5), ("c", 6)], [(None, 9), ("d", 1)], [(f"k{i}", i) for i in range(40)]]
    for i, batch in enumerate(batches):
        write(spark.createDataFrame(batch, PAIRS), i)
        model |= dict(batch)
        assert rows_of(read_upserted(spark, tmp_dir, schema)) == sorted(model.items(), key=repr)
    assert len(os.listdir(f"{tmp_dir}/manifest")) <= 2 + 1  # older versions are gone


def test_untouched_buckets_keep_their_files(spark, tmp_dir):
    write = upsert_writer(tmp_dir, ["k"], buckets=8)
    write(spark.createDataFrame([(f"k{i}", i) for i in range(64)], PAIRS), 0)
    schema = spark.createDataFrame([], PAIRS).schema
    before = set(read_upserted(spark, tmp_dir, schema).inputFiles())
    write(spark.createDataFrame([("k1", 100)], PAIRS), 1)
    after = set(read_upserted(spark, tmp_dir, schema).inputFiles())
    assert len(before - after) == 1 and len(after - before) == 1


def test_update_mode_counts_survive_a_crash_between_commit_and_checkpoint(spark, tmp_dir):
    landing, table, checkpoint = (os.path.join(tmp_dir, d) for d in ("in", "table", "ck"))
    words = spark.createDataFrame([(w,) for w in "a b a c a b".split()], "value STRING")
    words.repartition(3).write.text(landing)
    attempts = []

    def start():
        counts = spark.readStream.schema("value STRING").option("maxFilesPerTrigger", 1).text(landing).groupBy("value").count()
        body = upsert_writer(table, ["value"], buckets=2)

        def dies_once(batch, batch_id):
            body(batch, batch_id)
            if batch_id == 1 and not attempts:
                attempts.append(batch_id)
                raise RuntimeError("lost after the write of batch 1")

        return foreach_batch_sink(counts, dies_once, checkpoint, "update").trigger(availableNow=True).start()

    run_with_restart(start, max_attempts=3, delay_s=0)
    assert attempts == [1]
    schema = spark.createDataFrame([], "value STRING, count BIGINT").schema
    assert rows_of(read_upserted(spark, table, schema)) == [("a", 3), ("b", 2), ("c", 1)]


def test_replayed_batch_replaces_its_first_attempt(spark, tmp_dir):
    """The sink of the log stream dies after writing a batch and before its commit."""
    landing, table, checkpoint = (os.path.join(tmp_dir, d) for d in ("in", "table", "ck"))
    spark.createDataFrame([(str(i),) for i in range(20)], "value STRING").repartition(2).write.text(landing)
    died = []

    def start():
        write = idempotent_table_writer(table)

        def body(batch, batch_id):
            write(batch, batch_id)
            if not died:
                died.append(batch_id)
                raise RuntimeError("lost after the write")

        lines = spark.readStream.schema("value STRING").text(landing)
        return foreach_batch_sink(lines, body, checkpoint).trigger(availableNow=True).start()

    run_with_restart(start, max_attempts=3, delay_s=0)
    assert died == [0] and spark.read.parquet(table).count() == 20


# --- open runs ------------------------------------------------------------

RUN = "job_name STRING, execution_id BIGINT, correlation_id STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, exit_code INT"
T0 = dt.datetime(2024, 1, 1, 10, 0, 0, 123456)


def test_state_holds_open_runs_over_restarts(spark, tmp_dir):
    history, asked, table, checkpoint = (os.path.join(tmp_dir, d) for d in ("runs", "stops", "table", "ck"))
    schema = run_events(spark.createDataFrame([], RUN)).schema

    def land(events):
        spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(history)

    def ask(*ids):
        spark.createDataFrame([(i,) for i in ids], "value STRING").coalesce(1).write.mode("append").text(asked)

    def go():
        def start():
            actions = stop_actions(run_event_source(spark, history, schema), stop_request_source(spark, asked), lanes=3)
            return foreach_batch_sink(actions, idempotent_table_writer(table), checkpoint).trigger(availableNow=True).start()

        run_with_restart(start, max_attempts=1, delay_s=0)
        return sorted(r["execution_id"] for r in spark.read.parquet(table).collect()) if os.path.isdir(table) else []

    def started(i, c, end=None):
        return ("start", "j", i, c, T0, end, 0)

    def ended(i, c):
        return ("end", "j", i, c, T0, T0 + dt.timedelta(hours=1), 0)

    ask("c1")  # nothing is open yet: ignored
    land([started(1, "c1"), started(2, "c1"), started(3, "c2"), ended(2, "c1"), ended(7, "c3"), started(9, None)])
    # One micro-batch: starts and ends come before the request, so run 1 is named and run 2, which has ended, is not.
    assert go() == [1]
    ask("c1", "c1", "zz")
    assert go() == [1]  # named once, however often it is asked for
    land([started(4, "c1"), ended(1, "c1"), started(7, "c3")])  # run 7 had ended before its start came
    ask("c1", "c2", "c3")
    assert go() == [1, 3, 4]
    (row,) = spark.read.parquet(table).filter("execution_id = 4").select("job_name", "correlation_id", "start_time", "end_time", "exit_code").collect()
    assert tuple(row) == ("j", "c1", T0, None, 0)


def test_history_as_events(spark):
    runs = spark.createDataFrame([("j", 1, "c", T0, T0 + dt.timedelta(1), 0), ("j", 2, "c", T0, None, 0)], RUN)
    got = {(r["kind"], r["execution_id"], r["end_time"] is None) for r in run_events(runs).collect()}
    assert got == {("start", 1, True), ("end", 1, False), ("start", 2, True)}


# --- observed counts, latest rows ------------------------------------------


def test_counts_come_from_the_job_that_writes(spark, tmp_dir):
    counted = CountedOutputs(spark)
    left = counted.watch("left", spark.range(100).withColumn("k", F.col("id") % 7), 10)
    out = counted.watch("out", left.groupBy("k").count(), 8)
    out.write.mode("overwrite").parquet(tmp_dir)
    assert rows_of(counted.checks()) == [("left", 100, 10, True), ("out", 7, 8, False)]
    with pytest.raises(ValueError):
        counted.watch("out", out, 1)
    with pytest.raises(ValueError):
        CountedOutputs(spark).checks()


def test_latest_per_group_by_hash_aggregates(spark):
    rows = [("a", 1, 5, "x"), ("a", 2, 1, "y"), ("a", 2, 3, "z"), ("b", None, 1, "p"), ("b", None, 2, "q"), (None, 1, 1, "n"), (None, 1, None, "m"), ("c", None, None, "o")]
    df = spark.createDataFrame(rows, "g STRING, t INT, i INT, v STRING")
    want = [("a", 2, 3, "z"), ("b", None, 2, "q"), (None, 1, 1, "n"), ("c", None, None, "o")]
    for unique in (True, False):
        assert rows_of(latest_per_group(df, "g", ["t", "i"], unique)) == sorted(want, key=repr)
    plan = explain_text(latest_per_group(df, "g", ["t", "i"], unique=True), "simple")
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert latest_per_group(df.limit(0), "g", ["t"], unique=True).collect() == []


def test_open_runs_of_many_ids_share_few_state_keys(spark, tmp_dir):
    history, asked, table, checkpoint = (os.path.join(tmp_dir, d) for d in ("runs", "stops", "table", "ck"))
    schema = run_events(spark.createDataFrame([], RUN)).schema
    keys = []

    def go(buckets):
        actions = stop_actions(run_event_source(spark, history, schema), stop_request_source(spark, asked), lanes=3, buckets=buckets)
        query = foreach_batch_sink(actions, idempotent_table_writer(table), checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        keys.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    def land(events):
        spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(history)

    spark.createDataFrame([], "value STRING").write.text(asked)
    # Ids share run numbers; run 1 of every id ends, in the same micro-batch, twice told; run 2 stays open.
    land([e for c in range(60) for e in [("end", "j", 1, f"c{c}", T0, T0, 0), *[("start", "j", i, f"c{c}", T0, None, 0) for i in (1, 1, 2)]]])
    go(5)
    spark.createDataFrame([(f"c{c}",) for c in range(0, 60, 2)], "value STRING").write.mode("append").text(asked)
    go(5)
    assert max(keys) <= 5
    got = sorted((r["correlation_id"], r["execution_id"]) for r in spark.read.parquet(table).collect())
    assert got == sorted((f"c{c}", 2) for c in range(0, 60, 2))
    # The others are still open; what was named is not named again.
    spark.createDataFrame([(f"c{c}",) for c in range(60)], "value STRING").write.mode("append").text(asked)
    go(5)
    got = sorted((r["correlation_id"], r["execution_id"]) for r in spark.read.parquet(table).collect())
    assert got == sorted((f"c{c}", 2) for c in range(60))
