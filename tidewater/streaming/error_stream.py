"""The error-log streaming job (J01, J03, J07, J08, A15 by file, B13).

source -> text -> parser step -> sink, all on a streaming DataFrame.  The
parser is the same function as the batch job's; the source is Kafka on a
cluster, or a folder of text files (one line per record) here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidewater.plans.error_logs import ParserStep, regex_parser
from tidewater.sources import files, kafka


def file_log_source(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, max_bytes_per_trigger: int | None = None
) -> DataFrame:
    """Text files as the stream source; each line becomes ``log_line``."""
    lines = files.read_stream(
        spark,
        files.FileOptions(path=path, format="text"),
        max_files_per_trigger=max_files_per_trigger,
        max_bytes_per_trigger=max_bytes_per_trigger,
    )
    return lines.withColumnRenamed("value", "log_line")


def kafka_log_source(spark: SparkSession, opts: kafka.KafkaOptions) -> DataFrame:
    """Kafka as the stream source; the binary value is cast to text."""
    return kafka.read_stream(spark, opts).selectExpr("CAST(value AS STRING) AS log_line")


def error_stream(lines: DataFrame, parser: ParserStep | None = None) -> DataFrame:
    """Streaming frame of parsed error records."""
    return lines.transform(parser or regex_parser())


def start_error_job(
    lines: DataFrame,
    sink: Callable[[DataFrame], DataStreamWriter],
    parser: ParserStep | None = None,
    available_now: bool = False,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Wire source -> parser -> sink and start it.

    ``available_now`` processes what is there in as many batches as the
    source limits allow, then stops; otherwise the query runs until stopped.
    """
    writer = sink(error_stream(lines, parser))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
