"""Live stop requests matched to open runs (D10, stream-static).

Each micro-batch of requests is reduced to distinct correlation ids and
semi-joined with the open runs, so a run is named once per batch however
many requests carry its id.  The matches of a batch go to that batch's own
partition (replay-safe), and each one is a stop action for the launcher.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewater.plans.runs import match_stop_requests
from tidewater.sources import files
from tidewater.streaming.launcher import QueryGroup
from tidewater.streaming.sinks import idempotent_table_writer


def stop_request_source(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, max_bytes_per_trigger: int | None = None
) -> DataFrame:
    """One correlation id per line (a message value), as a stream."""
    lines = files.read_stream(
        spark,
        files.FileOptions(path=path, format="text"),
        max_files_per_trigger=max_files_per_trigger,
        max_bytes_per_trigger=max_bytes_per_trigger,
    )
    return lines.select(F.trim(F.col("value")).alias("correlation_id"))


def stop_matcher(runs: Callable[[], DataFrame], table: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: match the batch's requests against the open runs.

    ``runs`` builds the static side per batch, so runs started after the
    query began are seen by later requests.
    """
    write = idempotent_table_writer(table)

    def body(batch: DataFrame, batch_id: int) -> None:
        write(match_stop_requests(runs(), batch), batch_id)

    return body


def stop_when_requested(
    requests: DataFrame,
    correlation_id: str,
    group: QueryGroup,
    checkpoint: str,
) -> DataStreamWriter:
    """Unstarted watcher: when a request names ``correlation_id``, stop ``group``.

    Each micro-batch asks only whether one matching request exists (a
    ``limit(1)`` probe), so the check is bounded whatever the batch size.
    Other ids are ignored.  Stopping goes on when one query fails to stop.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        hit = batch.where(F.col("correlation_id") == correlation_id).limit(1).count() > 0
        if hit:
            group.stop_all()

    return requests.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
