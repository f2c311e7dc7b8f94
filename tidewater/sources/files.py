"""File sources and sinks: CSV, JSON, Parquet and friends."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

# Formats, save modes and Parquet codecs the connector accepts.
FORMATS = ("csv", "json", "parquet", "orc", "text")
SAVE_MODES = ("append", "overwrite", "errorifexists", "ignore")
PARQUET_CODECS = ("none", "uncompressed", "snappy", "gzip", "lzo", "brotli", "lz4", "zstd")
NULL_TOKEN = "null"


@dataclass
class FileOptions:
    """Options of one file location.

    ``merge`` writes a single file through ``coalesce(1)``: it narrows the
    whole last stage to one task, so use it only for small outputs.
    """

    path: str
    format: str = "parquet"
    header: bool = True
    null_value: str = NULL_TOKEN
    multiline: bool = False
    compression: str | None = None
    save_mode: str = "overwrite"
    merge: bool = False
    partition_by: tuple[str, ...] = ()
    sampling_ratio: float | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.format not in FORMATS:
            raise ValueError(f"format must be one of {FORMATS}")
        if self.save_mode not in SAVE_MODES:
            raise ValueError(f"save mode must be one of {SAVE_MODES}")
        if self.format == "parquet" and self.compression and self.compression not in PARQUET_CODECS:
            raise ValueError(f"parquet compression must be one of {PARQUET_CODECS}")

    def read_options(self, infer_schema: bool = False) -> dict[str, str]:
        opts: dict[str, str] = {}
        if self.format == "csv":
            opts.update(header=str(self.header).lower(), nullValue=self.null_value)
            if infer_schema:
                opts["inferSchema"] = "true"
        if self.format in ("csv", "json") and self.multiline:
            opts["multiLine"] = "true"
        if infer_schema and self.sampling_ratio is not None and self.format in ("csv", "json"):
            # Only the inference pass samples; every row is still read afterwards.
            opts["samplingRatio"] = str(self.sampling_ratio)
        opts.update(self.extra)
        return opts

    def write_options(self) -> dict[str, str]:
        opts: dict[str, str] = {}
        if self.format == "csv":
            opts.update(header=str(self.header).lower(), nullValue=self.null_value)
        if self.compression:
            opts["compression"] = self.compression
        return opts


def read(spark: SparkSession, opts: FileOptions, schema: StructType | str | None = None) -> DataFrame:
    """Batch scan; a fixed schema skips inference (A01), else infer.

    Inferring a CSV or JSON schema costs an extra pass over the files before
    the query runs; on large inputs pass a schema, or bound the inference
    pass with ``sampling_ratio``.  Parquet and ORC keep their schema in the
    file footers, so they never need that pass.
    """
    reader = spark.read.format(opts.format).options(**opts.read_options(infer_schema=schema is None))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(opts.path)


def write(df: DataFrame, opts: FileOptions, extra: dict[str, str] | None = None) -> None:
    """Batch write (B01); ``extra`` options are applied last, so they win."""
    out = df.coalesce(1) if opts.merge else df
    writer = out.write.format(opts.format).mode(opts.save_mode).options(**opts.write_options())
    writer = writer.options(**(extra or {}))
    if opts.partition_by:
        writer = writer.partitionBy(*opts.partition_by)
    writer.save(opts.path)


CLEAN_SOURCE = ("off", "archive", "delete")


def read_stream(
    spark: SparkSession,
    opts: FileOptions,
    schema: StructType | str | None = None,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: int | None = None,
    clean_source: str = "off",
    archive_dir: str | None = None,
) -> DataFrame:
    """Streaming file source; new files in ``path`` become micro-batches.

    A micro-batch takes ``max_files_per_trigger`` files or (not both) about
    ``max_bytes_per_trigger``, all new files without a limit.
    For long-running sources ``clean_source="archive"`` (with
    ``archive_dir``) or ``"delete"`` removes processed files, so listing the
    folder does not grow with the history.
    """
    if clean_source not in CLEAN_SOURCE:
        raise ValueError(f"clean_source must be one of {CLEAN_SOURCE}")
    if clean_source == "archive" and not archive_dir:
        raise ValueError("archive needs archive_dir")
    if max_files_per_trigger and max_bytes_per_trigger:
        raise ValueError("limit a micro-batch by files or by bytes, not by both")
    reader = spark.readStream.format(opts.format).options(**opts.read_options())
    if schema is not None:
        reader = reader.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    if clean_source != "off":
        reader = reader.option("cleanSource", clean_source)
        if archive_dir:
            reader = reader.option("sourceArchiveDir", archive_dir)
    return reader.load(opts.path)


def write_stream(
    df: DataFrame,
    opts: FileOptions,
    checkpoint: str,
    extra: dict[str, str] | None = None,
    query_name: str | None = None,
) -> DataStreamWriter:
    """Unstarted file stream sink (B12).  File sinks only support ``append``."""
    writer = (
        df.writeStream.format(opts.format)
        .outputMode("append")
        .option("path", opts.path)
        .option("checkpointLocation", checkpoint)
        .options(**opts.write_options())
        .options(**(extra or {}))
    )
    if opts.partition_by:
        writer = writer.partitionBy(*opts.partition_by)
    if query_name:
        writer = writer.queryName(query_name)
    return writer


def object_store_conf(
    scheme: str,
    endpoint: str | None = None,
    access_key: str | None = None,
    secret_key: str | None = None,
    path_style: bool = False,
) -> dict[str, str]:
    """Hadoop settings for ``s3a://`` paths (A17); pass to the session builder.

    Credentials are better taken from the environment's provider chain; the
    explicit keys are for object stores that need them.
    """
    if scheme != "s3a":
        # gs:// and abfs:// read their settings from the cluster's defaults.
        return {}
    conf = {"spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem"}
    if endpoint:
        conf["spark.hadoop.fs.s3a.endpoint"] = endpoint
    if access_key and secret_key:
        conf["spark.hadoop.fs.s3a.access.key"] = access_key
        conf["spark.hadoop.fs.s3a.secret.key"] = secret_key
    if path_style:
        conf["spark.hadoop.fs.s3a.path.style.access"] = "true"
    return conf
