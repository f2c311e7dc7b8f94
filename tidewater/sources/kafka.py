"""Kafka source and sinks.

The Kafka package must be on the classpath; without it the calls raise
``ConnectorUnavailable``.  Payload parsing (A16) is a plain column
expression and works on any frame with a binary ``value``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tidewater.sources.errors import guarded

KAFKA_FORMAT = "kafka"
STARTING_OFFSETS = ("latest", "earliest")


@dataclass
class KafkaOptions:
    bootstrap_servers: str
    topic: str
    starting_offsets: str = "latest"
    fail_on_data_loss: bool = False
    max_offsets_per_trigger: int | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.starting_offsets not in STARTING_OFFSETS and not self.starting_offsets.startswith("{"):
            raise ValueError("starting_offsets must be latest, earliest or a JSON offsets map")

    def read_options(self) -> dict[str, str]:
        opts = {
            "kafka.bootstrap.servers": self.bootstrap_servers,
            "subscribe": self.topic,
            "startingOffsets": self.starting_offsets,
            "failOnDataLoss": str(self.fail_on_data_loss).lower(),
        }
        if self.max_offsets_per_trigger:
            opts["maxOffsetsPerTrigger"] = str(self.max_offsets_per_trigger)
        opts.update(self.extra)
        return opts

    def write_options(self) -> dict[str, str]:
        # Spark's Kafka sink sets its own byte serializers; none are passed.
        return {"kafka.bootstrap.servers": self.bootstrap_servers, "topic": self.topic, **self.extra}


def read_stream(spark: SparkSession, opts: KafkaOptions) -> DataFrame:
    """Subscribe to a topic."""
    return guarded(KAFKA_FORMAT, lambda: spark.readStream.format(KAFKA_FORMAT).options(**opts.read_options()).load())


def parse_json_payload(
    df: DataFrame,
    schema: StructType | str,
    value_column: str = "value",
    keep: list[str] | None = None,
) -> DataFrame:
    """Binary JSON payload -> typed columns (A16); Kafka's own columns are fixed,
    so the schema goes on the value."""
    parsed = F.from_json(F.col(value_column).cast("string"), schema).alias("payload")
    return df.select(*(keep or []), parsed).select(*(keep or []), "payload.*")


def to_kafka_records(df: DataFrame, value_columns: list[str] | None = None, key_column: str | None = None) -> DataFrame:
    """``key`` / ``value`` columns for the sink: value as JSON of the chosen columns."""
    cols = value_columns or df.columns
    value = F.to_json(F.struct(*cols)).alias("value")
    if key_column:
        return df.select(F.col(key_column).cast("string").alias("key"), value)
    return df.select(value)


def write(df: DataFrame, opts: KafkaOptions) -> None:
    """Batch write of ``key`` / ``value`` records."""
    guarded(KAFKA_FORMAT, lambda: df.write.format(KAFKA_FORMAT).options(**opts.write_options()).save())


def write_stream(df: DataFrame, opts: KafkaOptions, checkpoint: str) -> DataStreamWriter:
    """Unstarted streaming sink."""
    return (
        df.writeStream.format(KAFKA_FORMAT)
        .options(**opts.write_options())
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
