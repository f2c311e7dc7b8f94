"""Document-store connectors: MongoDB and ArangoDB.

Both need their Spark connector packages on the classpath; without them the
calls raise ``ConnectorUnavailable``.  Filters and projections are applied as
DataFrame steps after the load so Catalyst pushes them into the connector.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tidewater.operators.scan import filtered_scan
from tidewater.sources.errors import guarded

MONGO_FORMAT = "mongodb"
ARANGO_FORMAT = "com.arangodb.spark"


@dataclass
class MongoOptions:
    connection_uri: str
    database: str
    extra: dict[str, str] = field(default_factory=dict)

    def read_options(self, collection: str) -> dict[str, str]:
        return {
            "connection.uri": self.connection_uri,
            "database": self.database,
            "collection": collection,
            **self.extra,
        }

    def write_options(self, collection: str) -> dict[str, str]:
        return self.read_options(collection)


def mongo_read(
    spark: SparkSession,
    opts: MongoOptions,
    collection: str,
    schema: StructType | str | None = None,
    pipeline: Sequence[dict] | None = None,
) -> DataFrame:
    """Collection scan (A08), fixed schema (A09), server-side pipeline."""
    reader = spark.read.format(MONGO_FORMAT).options(**opts.read_options(collection))
    if pipeline:
        reader = reader.option("aggregation.pipeline", json.dumps(list(pipeline)))
    if schema is not None:
        reader = reader.schema(schema)
    return guarded(MONGO_FORMAT, reader.load)


def mongo_write(df: DataFrame, opts: MongoOptions, collection: str, mode: str = "append") -> None:
    """Collection write."""
    writer = df.write.format(MONGO_FORMAT).mode(mode).options(**opts.write_options(collection))
    guarded(MONGO_FORMAT, writer.save)


def mongo_write_stream(df: DataFrame, opts: MongoOptions, collection: str, checkpoint: str) -> DataStreamWriter:
    """Unstarted streaming sink into a collection."""
    return (
        df.writeStream.format(MONGO_FORMAT)
        .options(**opts.write_options(collection))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


@dataclass
class ArangoOptions:
    endpoints: str
    database: str = "_system"
    user: str = "root"
    password: str = ""
    batch_size: int = 1000
    ssl: bool = False
    ssl_certificate: str | None = None  # Base64 text
    cursor_ttl_s: int | None = None  # lifetime of a read cursor
    extra: dict[str, str] = field(default_factory=dict)

    def base(self) -> dict[str, str]:
        opts = {
            "endpoints": self.endpoints,
            "database": self.database,
            "user": self.user,
            "password": self.password,
            "batchSize": str(self.batch_size),
        }
        if self.ssl:
            opts["ssl.enabled"] = "true"
        if self.ssl_certificate is not None:
            opts["ssl.cert.value"] = self.ssl_certificate
        return {**opts, **self.extra}

    def read_options(self, collection: str | None = None, query: str | None = None) -> dict[str, str]:
        opts = self.base()
        if (collection is None) == (query is None):
            raise ValueError("give exactly one of collection or query")
        if collection is not None:
            opts["table"] = collection
        else:
            opts["query"] = query
        if self.cursor_ttl_s is not None:
            opts.setdefault("ttl", str(self.cursor_ttl_s))
        return opts

    def write_options(self, collection: str, mode: str = "append") -> dict[str, str]:
        """Overwriting truncates the collection, which the connector wants confirmed."""
        confirmed = {"confirmTruncate": "true"} if mode.lower() == "overwrite" else {}
        return {**confirmed, **self.base(), "table": collection}


def arango_read_all(spark: SparkSession, opts: ArangoOptions, collection: str, schema: StructType | str | None = None) -> DataFrame:
    """Collection scan."""
    reader = spark.read.format(ARANGO_FORMAT).options(**opts.read_options(collection=collection))
    if schema is not None:
        reader = reader.schema(schema)
    return guarded(ARANGO_FORMAT, reader.load)


def arango_read_query(spark: SparkSession, opts: ArangoOptions, query: str, schema: StructType | str | None = None) -> DataFrame:
    """Query scan."""
    reader = spark.read.format(ARANGO_FORMAT).options(**opts.read_options(query=query))
    if schema is not None:
        reader = reader.schema(schema)
    return guarded(ARANGO_FORMAT, reader.load)


def arango_read(
    spark: SparkSession,
    opts: ArangoOptions,
    collection: str,
    condition: str | None = None,
    projection: Sequence[str] | None = None,
) -> DataFrame:
    """Scan with optional filter and projection; both blank is a full scan."""
    return filtered_scan(arango_read_all(spark, opts, collection), condition, projection)


def arango_write(df: DataFrame, opts: ArangoOptions, collection: str, mode: str = "append") -> None:
    """Collection write."""
    writer = df.write.format(ARANGO_FORMAT).mode(mode).options(**opts.write_options(collection, mode))
    guarded(ARANGO_FORMAT, writer.save)
