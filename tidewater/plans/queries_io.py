"""Registered source/sink round trips.

Each writes a whole table below the shared checkpoint folder and reads it
back; the oracle is the input table itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans import views
from tidewater.plans.error_logs import error_counts, extract_errors
from tidewater.plans.queries_logs import PARSE_SQL
from tidewater.plans.registry import register
from tidewater.session import scratch_path
from tidewater.sources import files
from tidewater.sources.registry import read_with

PART_DDL = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
PART_SQL = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"
PARTS_PER_PAGE = 500
# Codecs available without extra native libraries.
WORKING_CODECS = ("uncompressed", "snappy", "gzip", "lz4", "zstd", "none")


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part")


@register("file_csv_roundtrip", "A01 A03 B01 B02 B05 A18", PART_SQL)
def q_file_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    opts = files.FileOptions(path=scratch_path(spark, "csv"), format="csv")
    files.write(_part(spark, sf_dir), opts, extra={"quoteAll": "true"})
    return read_with("file", spark, opts, PART_DDL)


@register("file_json_roundtrip", "A02 B01", PART_SQL)
def q_file_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    opts = files.FileOptions(path=scratch_path(spark, "json"), format="json")
    files.write(_part(spark, sf_dir), opts)
    # Inferred: JSON numbers come back as BIGINT / DOUBLE; cast to the table's types.
    back = files.read(spark, opts)
    return back.select(
        "p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("int").alias("p_size"), "p_retailprice"
    )


@register("file_json_multiline", "A02 A04", PART_SQL)
def q_file_json_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of many lines: every file is one indented JSON array that holds one catalogue page with its parts nested.

    A file is read whole by one task, so a page has at most ``PARTS_PER_PAGE``
    parts, however many there are.
    """
    part = _part(spark, sf_dir)
    names = [c.split()[0] for c in PART_DDL.split(", ")]
    page = F.floor(F.col("p_partkey") / PARTS_PER_PAGE).alias("page")
    pages = part.groupBy(page).agg(F.collect_list(F.struct(*names)).alias("parts"))
    document = F.concat(F.lit("[\n"), F.to_json(F.struct("page", "parts"), {"pretty": "true"}), F.lit("\n]"))
    path = scratch_path(spark, "json_documents")
    pages.select(document.alias("value"), F.col("page").alias("document")).write.partitionBy("document").text(path)
    back = files.read(spark, files.FileOptions(path=path, format="json", multiline=True))
    rows = back.select(F.explode("parts").alias("p")).select("p.*")
    return rows.select(*[F.col(n).cast("int").alias(n) if n == "p_size" else F.col(n) for n in names])


@register(
    "file_parquet_codecs",
    "A05 B04 B05",
    "SELECT codec, p.* FROM (" + PART_SQL + ") p, (VALUES " + ", ".join(f"('{c}')" for c in WORKING_CODECS) + ") v(codec)",
)
def q_file_parquet_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the table once per codec, each copy written with that codec and read back."""
    part = _part(spark, sf_dir).select(*[c.split()[0] for c in PART_DDL.split(", ")])
    outs = []
    for codec in WORKING_CODECS:
        opts = files.FileOptions(path=scratch_path(spark, "parquet", codec), compression=codec)
        files.write(part, opts)
        outs.append(files.read(spark, opts).withColumn("codec", F.lit(codec)))
    return reduce(DataFrame.unionByName, outs)


@register(
    "file_save_modes",
    "B05",
    f"SELECT * FROM ({PART_SQL}) UNION ALL SELECT * FROM ({PART_SQL})",
)
def q_file_save_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """overwrite, then ignore (no-op), then append: two copies of the table."""
    path = scratch_path(spark, "modes")
    part = _part(spark, sf_dir).select(*[c.split()[0] for c in PART_DDL.split(", ")])
    for mode in ("overwrite", "ignore", "append"):
        files.write(part, files.FileOptions(path=path, save_mode=mode))
    try:
        files.write(part, files.FileOptions(path=path, save_mode="errorifexists"))
        raise AssertionError("errorifexists wrote into an existing path")
    except AssertionError:
        raise
    except Exception:  # noqa: BLE001 - expected: the path exists
        pass
    return files.read(spark, files.FileOptions(path=path))


@register(
    "file_merge_summary",
    "B03 B01 A01 A03",
    f"SELECT application, count(*) AS error_count FROM ({PARSE_SQL}) GROUP BY application",
)
def q_file_merge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary bounded by the number of applications, written as one CSV file.

    ``merge`` narrows the last stage to one task, so it is used on an
    aggregate whose size does not grow with the input.
    """
    summary = error_counts(extract_errors(views.log_lines(spark, sf_dir)))
    opts = files.FileOptions(path=scratch_path(spark, "summary"), format="csv", merge=True)
    files.write(summary, opts)
    return files.read(spark, opts, "application STRING, error_count BIGINT")
