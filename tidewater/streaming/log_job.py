"""spark-submit entry point of the error-log stream.

    spark-submit --py-files tidewater.zip tidewater/streaming/log_job.py --source kafka --bootstrap b:9092 --topic logs \\
        --sink-path s3a://lake/error_logs
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.session import build_session, checkpoint_root
from tidewater.sources import files, jdbc, kafka
from tidewater.streaming.error_stream import file_log_source, kafka_log_source, start_error_job
from tidewater.streaming.launcher import run_with_restart
from tidewater.streaming.sinks import foreach_batch_sink, idempotent_table_writer


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="error-log-stream", description="Error records from log streams")
    p.add_argument("--source", default="kafka", choices=["kafka", "files"])
    p.add_argument("--bootstrap")
    p.add_argument("--topic")
    p.add_argument("--starting-offsets", default="latest")
    p.add_argument("--max-offsets", type=int, default=None, help="records per micro-batch at most (Kafka)")
    p.add_argument("--trigger", default=None, help="processing-time interval, e.g. '30 seconds'")
    p.add_argument("--path", help="folder of text files (files source)")
    p.add_argument("--max-files", type=int, default=None)
    p.add_argument(
        "--sink", default="files", choices=["files", "table", "jdbc"],
        help="files: Spark's file sink, exactly-once through its commit log, partitioned by day; "
        "table: foreachBatch into stream_id / batch_id partitions; jdbc: foreachBatch JDBC append",
    )
    p.add_argument("--sink-path", help="error table root (files and table sinks)")
    p.add_argument("--jdbc-url")
    p.add_argument("--jdbc-table", default="error_logs")
    p.add_argument("--jdbc-user")
    p.add_argument("--jdbc-password")
    p.add_argument("--checkpoint", help="default: <spark.checkpoint.dir>/tidewater/error_logs")
    p.add_argument("--available-now", action="store_true", help="process what is there, then stop")
    p.add_argument("--max-attempts", type=int, default=None, help="default: restart without limit")
    p.add_argument("--restart-delay", type=float, default=5.0)
    return p.parse_args(argv)


def _source(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.source == "kafka":
        return kafka_log_source(
            spark,
            kafka.KafkaOptions(
                args.bootstrap, args.topic, starting_offsets=args.starting_offsets,
                max_offsets_per_trigger=args.max_offsets,
            ),
        )
    return file_log_source(spark, args.path, args.max_files)


def _body(args: argparse.Namespace):
    if args.sink == "jdbc":
        return jdbc.batch_writer(jdbc.JdbcOptions(args.jdbc_url, user=args.jdbc_user, password=args.jdbc_password), args.jdbc_table)
    return idempotent_table_writer(args.sink_path)


def _file_sink(args: argparse.Namespace, checkpoint: str):
    opts = files.FileOptions(path=args.sink_path, format="parquet", partition_by=("log_day",))

    def sink(df: DataFrame):
        return files.write_stream(
            df.withColumn("log_day", F.substring("datetime", 1, 10)), opts, checkpoint, query_name="error_logs"
        )

    return sink


def run(spark: SparkSession, args: argparse.Namespace) -> StreamingQuery:
    checkpoint = args.checkpoint or checkpoint_root(spark).rstrip("/") + "/tidewater/error_logs"
    if args.sink == "files":
        sink = _file_sink(args, checkpoint)
    else:
        body = _body(args)

        def sink(df: DataFrame):
            return foreach_batch_sink(df, body, checkpoint, query_name="error_logs")

    def start() -> StreamingQuery:
        return start_error_job(
            _source(spark, args), sink, available_now=args.available_now, processing_time=args.trigger
        )

    return run_with_restart(start, max_attempts=args.max_attempts, delay_s=args.restart_delay)


def main(argv: list[str] | None = None) -> None:
    args = parse_args(argv)
    spark = build_session(app_name="error-log-stream")
    run(spark, args)


if __name__ == "__main__":
    main()
