"""JDBC source and sink, batch and per-micro-batch.

Reads are split across executors with ``partitionColumn`` / bounds /
``numPartitions`` when given; without them a JDBC read is a single task.
Writes go out in ``batchsize`` statements per partition, in parallel.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.streaming.sinks import BATCH_ID_COLUMN, STREAM_ID_COLUMN, stream_id_of

# Isolation levels Spark's JDBC writer accepts.
ISOLATION_LEVELS = ("NONE", "READ_UNCOMMITTED", "READ_COMMITTED", "REPEATABLE_READ", "SERIALIZABLE")
# How PostgreSQL, MySQL / SQL Server, H2, Derby, DB2 (states) and Oracle (code) report a missing table.
MISSING_TABLE_STATES = ("42P01", "42S02", "42S04", "42X05", "42704")
MISSING_TABLE_CODES = (942,)
DIGEST_COLUMN = "row_digest"
#: First digits of digests: a replayed batch is read in so many parts.
DIGEST_SPLITS = "0123456789abcdef"


@dataclass
class JdbcOptions:
    url: str
    driver: str | None = None
    user: str | None = None
    password: str | None = None
    fetch_size: int = 1000
    batch_size: int = 1000
    isolation_level: str = "READ_UNCOMMITTED"
    create_table_options: str | None = None
    partition_column: str | None = None
    lower_bound: int | None = None
    upper_bound: int | None = None
    num_partitions: int | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.isolation_level not in ISOLATION_LEVELS:
            raise ValueError(f"isolation level must be one of {ISOLATION_LEVELS}")
        split = (self.partition_column, self.lower_bound, self.upper_bound, self.num_partitions)
        if any(v is not None for v in split) and not all(v is not None for v in split):
            raise ValueError("partition_column, lower_bound, upper_bound and num_partitions go together")

    def _common(self) -> dict[str, str]:
        opts = {"url": self.url}
        if self.driver:
            opts["driver"] = self.driver
        if self.user is not None:
            opts["user"] = self.user
        if self.password is not None:
            opts["password"] = self.password
        return opts

    def read_options(self) -> dict[str, str]:
        opts = self._common()
        opts["fetchsize"] = str(self.fetch_size)
        if self.partition_column:
            opts.update(
                partitionColumn=self.partition_column,
                lowerBound=str(self.lower_bound),
                upperBound=str(self.upper_bound),
                numPartitions=str(self.num_partitions),
            )
        opts.update(self.extra)
        return opts

    def write_options(self) -> dict[str, str]:
        # The batch size goes under ``batchsize`` (the reference put it under
        # the fetch-size key, where the writer ignores it).
        opts = self._common()
        opts.update(batchsize=str(self.batch_size), isolationLevel=self.isolation_level)
        if self.create_table_options:
            opts["createTableOptions"] = self.create_table_options
        if self.num_partitions:
            opts["numPartitions"] = str(self.num_partitions)
        opts.update(self.extra)
        return opts


def read_table(spark: SparkSession, opts: JdbcOptions, table: str, custom_schema: str | None = None) -> DataFrame:
    """Table scan (A06); declared column types via ``customSchema`` DDL.

    Spark rejects ``.schema()`` on JDBC, so declared types go through the
    ``customSchema`` option instead.
    """
    reader = spark.read.format("jdbc").options(**opts.read_options()).option("dbtable", table)
    if custom_schema:
        reader = reader.option("customSchema", custom_schema)
    return reader.load()


def read_query(spark: SparkSession, opts: JdbcOptions, query: str) -> DataFrame:
    """A query run in the database (A13); it cannot be combined with partitionColumn."""
    if opts.partition_column:
        raise ValueError("a query read cannot be split by partitionColumn; use read_table on a subquery alias")
    return spark.read.format("jdbc").options(**opts.read_options()).option("query", query).load()


def write_table(
    df: DataFrame,
    opts: JdbcOptions,
    table: str,
    mode: str = "append",
    extra: dict[str, str] | None = None,
) -> None:
    """Batch write (B06, B07); ``extra`` wins over the defaults."""
    df.write.format("jdbc").mode(mode).options(**opts.write_options()).options(**(extra or {})).option(
        "dbtable", table
    ).save()


def is_missing_table(error: BaseException) -> bool:
    """Whether a failed read says that the table does not exist, by the SQLSTATE (or vendor code) of its causes."""
    cause = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while cause is not None:
        try:
            if cause.getSQLState() in MISSING_TABLE_STATES or cause.getErrorCode() in MISSING_TABLE_CODES:
                return True
        except (Py4JError, AttributeError):  # a cause that is no SQL exception
            pass
        cause = cause.getCause()
    return False


def stamped(batch: DataFrame, stream_id: str, batch_id: int) -> DataFrame:
    """The rows of a micro-batch with the stream's id, the batch's id and a digest of the row."""
    return batch.withColumn(DIGEST_COLUMN, F.sha2(F.to_json(F.struct("*")), 256)).withColumns(
        {STREAM_ID_COLUMN: F.lit(stream_id), BATCH_ID_COLUMN: F.lit(batch_id).cast("long")}
    )


def missing_rows(batch: DataFrame, written: DataFrame) -> DataFrame:
    """Rows of a ``stamped`` batch beyond those whose digests are ``written``; equal rows count as often as they occur."""
    there = written.groupBy(DIGEST_COLUMN).agg(F.count(F.lit(1)).alias("n_there"))
    rows = batch.groupBy(DIGEST_COLUMN).agg(F.first(F.struct(*batch.columns)).alias("row"), F.count(F.lit(1)).alias("n"))
    left = rows.join(there, DIGEST_COLUMN, "left").withColumn("n", F.col("n") - F.coalesce("n_there", F.lit(0)))
    copies = F.array_repeat("row", F.col("n").cast("int"))
    return left.filter("n > 0").select(F.explode(copies).alias("row")).select("row.*")


def batch_writer(
    opts: JdbcOptions,
    table: str,
    extra: dict[str, str] | None = None,
    exactly_once: bool = True,
    committed_batches: Callable[[int], bool] | None = None,
    stream_id: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body that appends each micro-batch.

    The options are applied inside the body, on the batch write itself; the
    batch is written in parallel, one transaction per connection.

    ``exactly_once`` (default): every row carries ``stream_id`` (kept in the
    stream's checkpoint; a parameter replaces it), ``batch_id`` and
    ``row_digest``.  If the table already holds rows of this batch of this
    stream, an attempt died on the way: the digests there are read, split
    over ``DIGEST_SPLITS`` connections, and only the rows missing are
    appended.  Other streams, and a new checkpoint, never count as this one.
    A batch that ``committed_batches(batch_id)`` reports is not written at all.

    ``exactly_once=False`` appends without these columns: a replay may
    duplicate rows (at-least-once), like a plain append.
    """
    write_opts = dict(opts.write_options())
    write_opts.update(extra or {})
    read_opts = {k: v for k, v in opts.read_options().items()
                 if k not in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")}

    def written(spark: SparkSession, stream: str, batch_id: int) -> DataFrame | None:
        """Digests of this batch in the table; None on its first attempt."""
        own = f"{STREAM_ID_COLUMN} = '{stream.replace(chr(39), chr(39) * 2)}' AND {BATCH_ID_COLUMN} = {int(batch_id)}"
        try:
            probe = spark.read.format("jdbc").options(**read_opts).option("query", f"SELECT 1 AS hit FROM {table} WHERE {own}").load()
            if not probe.limit(1).count():
                return None
        except Exception as e:  # noqa: BLE001 - whatever the driver raises; only one reason is no failure
            if is_missing_table(e):
                return None
            raise
        parts = [f"{own} AND {DIGEST_COLUMN} LIKE '{digit}%'" for digit in DIGEST_SPLITS]
        properties = {k: v for k, v in read_opts.items() if k != "url"}
        return spark.read.jdbc(opts.url, table, predicates=parts, properties=properties).select(DIGEST_COLUMN)

    def write_batch(batch_df: DataFrame, batch_id: int) -> None:
        out = batch_df
        if exactly_once:
            if committed_batches is not None and committed_batches(batch_id):
                return
            stream = stream_id or stream_id_of(batch_df)
            out = stamped(batch_df, stream, batch_id)
            there = written(batch_df.sparkSession, stream, batch_id)
            if there is not None:
                out = missing_rows(out, there)
        out.write.format("jdbc").mode("append").options(**write_opts).option("dbtable", table).save()

    return write_batch
