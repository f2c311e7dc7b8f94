"""Connector chosen by kind (A18): one reader/writer pair per kind, options as objects."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession

from tidewater.sources import documents, files, jdbc, kafka


class ConnectorType(str, Enum):
    FILE = "file"
    JDBC = "jdbc"
    MONGODB = "mongodb"
    ARANGODB = "arangodb"
    KAFKA = "kafka"


@dataclass(frozen=True)
class Connector:
    kind: ConnectorType
    read: Callable[..., DataFrame] | None
    write: Callable[..., None] | None
    read_stream: Callable[..., DataFrame] | None
    write_stream: Callable[..., object] | None


CONNECTORS: dict[ConnectorType, Connector] = {
    ConnectorType.FILE: Connector(ConnectorType.FILE, files.read, files.write, files.read_stream, files.write_stream),
    ConnectorType.JDBC: Connector(ConnectorType.JDBC, jdbc.read_table, jdbc.write_table, None, None),
    ConnectorType.MONGODB: Connector(
        ConnectorType.MONGODB, documents.mongo_read, documents.mongo_write, None, documents.mongo_write_stream
    ),
    ConnectorType.ARANGODB: Connector(
        ConnectorType.ARANGODB, documents.arango_read_all, documents.arango_write, None, None
    ),
    ConnectorType.KAFKA: Connector(ConnectorType.KAFKA, None, kafka.write, kafka.read_stream, kafka.write_stream),
}


def connector(kind: str | ConnectorType, enabled: set[str] | None = None) -> Connector:
    """The connector of ``kind``; an error if it is unknown or not enabled."""
    try:
        key = ConnectorType(kind)
    except ValueError as e:
        raise ValueError(f"unknown connector {kind!r}; known: {[k.value for k in ConnectorType]}") from e
    if enabled is not None and key.value not in enabled:
        raise LookupError(f"connector {key.value!r} is not enabled")
    return CONNECTORS[key]


def read_with(kind: str, spark: SparkSession, *args, **kwargs) -> DataFrame:
    c = connector(kind)
    if c.read is None:
        raise LookupError(f"connector {kind!r} has no batch reader")
    return c.read(spark, *args, **kwargs)
