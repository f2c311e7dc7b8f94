"""Streaming sinks: idempotent per-batch table writes, console and memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

# Output modes of a streaming write.
OUTPUT_MODES = ("append", "complete", "update")
STREAM_ID_COLUMN = "stream_id"
BATCH_ID_COLUMN = "batch_id"
#: Columns the batch writers add to every row.
SINK_COLUMNS = (STREAM_ID_COLUMN, BATCH_ID_COLUMN)
#: Fixed value: the property Spark sets for the jobs of a streaming query; the id lives in its checkpoint.
QUERY_ID_PROPERTY = "sql.streaming.queryId"


def output_mode(mode: str) -> str:
    """Validate an output mode (J02); ``complete`` needs an aggregation."""
    m = mode.lower()
    if m not in OUTPUT_MODES:
        raise ValueError(f"output mode must be one of {OUTPUT_MODES}, got {mode!r}")
    return m


def stream_id_of(batch: DataFrame) -> str:
    """Id of the streaming query whose ``foreachBatch`` body runs; ``manual`` outside of one.

    Spark keeps it in the checkpoint: a restart has the same id and goes on
    counting batches, a new checkpoint starts at batch 0 under a new id.
    """
    return batch.sparkSession.sparkContext.getLocalProperty(QUERY_ID_PROPERTY) or "manual"


def idempotent_table_writer(path: str, fmt: str = "parquet", stream_id: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: each micro-batch replaces its own ``stream_id``, ``batch_id`` partition.

    A batch replayed after a failure overwrites what its first attempt wrote
    instead of appending a second copy, so the table is exactly-once even
    though the reference's append sink is at-least-once.  Several streams, or
    one stream after a new checkpoint, keep apart in one table.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn(STREAM_ID_COLUMN, F.lit(stream_id or stream_id_of(batch)))
            .withColumn(BATCH_ID_COLUMN, F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*SINK_COLUMNS)
            .format(fmt)
            .save(path)
        )

    return write_batch


def snapshot_writer(path: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body for ``complete`` mode: each batch is the whole result; replace it."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(path)

    return write_batch


def foreach_batch_sink(
    df: DataFrame,
    body: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    query_name: str | None = None,
) -> DataStreamWriter:
    """Unstarted ``foreachBatch`` writer with its own checkpoint."""
    writer = df.writeStream.foreachBatch(body).outputMode(output_mode(mode)).option("checkpointLocation", checkpoint)
    return writer.queryName(query_name) if query_name else writer


def console_sink(df: DataFrame, mode: str = "append", rows: int = 20) -> DataStreamWriter:
    """Console sink for manual runs (B17); it prints each batch on the driver."""
    return df.writeStream.format("console").outputMode(output_mode(mode)).option("numRows", rows).option(
        "truncate", "false"
    )


def memory_sink(df: DataFrame, name: str, mode: str = "append") -> DataStreamWriter:
    """In-memory table for tests (B17); it keeps every row on the driver."""
    return df.writeStream.format("memory").queryName(name).outputMode(output_mode(mode))
