"""Exact record numbers and deep pages over a sorted table.

A rank index is a table on the shared file system: the rows in key order, cut
into ranges of about equal size, each range a folder whose rows carry their
offset within it, and one small table of the rows before every range.  Building
it costs one range shuffle.  After that

* a row's number is its range's start plus its offset, without any further sort;
* a page reads only the folders of the ranges it overlaps, however deep it lies,
  and no task ever merges ``offset + size`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import scratch_path

RANGE, OFFSET = "_range", "_offset"
#: monotonically_increasing_id() counts rows of a task in its lower 33 bits.
_ROW_BITS = (1 << 33) - 1


def sort_columns(keys: Sequence[tuple[str, bool]]) -> list[Column]:
    """(column, ascending) pairs as sort columns; NULL is the smallest value."""
    return [F.col(k).asc_nulls_first() if asc else F.col(k).desc_nulls_last() for k, asc in keys]


@dataclass(frozen=True)
class RankIndex:
    """Rows in order below ``root``/rows, the rows before each range in ``root``/starts."""

    spark: SparkSession
    root: str
    schema: T.StructType
    total: int

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(OFFSET, T.LongType()), T.StructField(RANGE, T.IntegerType())])

    def _rows(self, *folders: str) -> DataFrame:
        base = f"{self.root}/rows"
        return self.spark.read.schema(self._stored()).option("basePath", base).parquet(*(folders or [base]))

    def starts(self) -> DataFrame:
        """One row per range: ``_range``, rows in it, rows before it."""
        return self.spark.read.parquet(f"{self.root}/starts")

    def numbered(self, out: str = "record_number", first: int = 1, keep_range: bool = False) -> DataFrame:
        """All rows with their exact number in key order, counted from ``first``.

        The join partner has one row per range, so Spark broadcasts it while it
        is below the threshold and shuffles by range, never by a data key, beyond.
        """
        numbered = self._rows().join(self.starts().select(RANGE, "before"), RANGE)
        number = (F.col("before") + F.col(OFFSET) + F.lit(first)).alias(out)
        return numbered.select(*[c for c in self.schema.names if c != out], *([RANGE] if keep_range else []), number)

    def slice(self, start: int, stop: int, out: str | None = None) -> DataFrame:
        """Rows ``start`` to ``stop`` (0-based, end excluded), optionally with their 1-based number.

        Only the ranges that overlap are read, by their folders.  Rows come
        unsorted out of a distributed read; sort the (page-sized) result if the
        order matters.
        """
        if start < 0 or stop < start:
            raise ValueError("a slice needs 0 <= start <= stop")
        # At most the ranges of one page: bounded by the page, not by the table.
        hit = self.starts().filter((F.col("before") < stop) & (F.col("before") + F.col("rows") > start)).select(RANGE, "before").collect()
        names = [c for c in self.schema.names if c != out]
        number = [(F.col("_position") + 1).alias(out)] if out else []
        if not hit:
            return self._rows().limit(0).withColumn("_position", F.lit(0).cast("long")).select(*names, *number)
        rows = self._rows(*[f"{self.root}/rows/{RANGE}={r[RANGE]}" for r in hit])
        # One when() per overlapping range.
        before = F.coalesce(*[F.when(F.col(RANGE) == r[RANGE], F.lit(r["before"])) for r in hit])
        placed = rows.withColumn("_position", before + F.col(OFFSET))
        return placed.filter((F.col("_position") >= start) & (F.col("_position") < stop)).select(*names, *number)

    def page(self, number: int, size: int, out: str | None = None) -> DataFrame:
        """Page ``number`` (0-based) of ``size`` rows."""
        if number < 0 or size < 0:
            raise ValueError("page number and size must not be negative")
        return self.slice(number * size, (number + 1) * size, out)


def build_rank_index(
    df: DataFrame, keys: Sequence[tuple[str, bool]], root: str | None = None, ranges: int | None = None
) -> RankIndex:
    """Sort ``df`` by ``keys`` into a rank index below ``root`` (a fresh scratch folder unless given).

    The last key should be unique: rows equal in all keys lie in one range and
    are numbered in any order, the same at every later read.  ``ranges``
    defaults to the session's shuffle partitions.
    """
    for name in (RANGE, OFFSET):
        if name in df.columns:
            raise ValueError(f"column {name!r} is reserved")
    spark = df.sparkSession
    root = (root or scratch_path(spark, "rank_index")).rstrip("/")
    order = sort_columns(keys)
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    # A range is what one task holds after the range shuffle.  It leads the sort so that the writer, which wants its
    # rows by folder, does not sort them again.
    in_order = dealt.withColumn(RANGE, F.spark_partition_id()).sortWithinPartitions(RANGE, *order)
    placed = in_order.withColumn(OFFSET, F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    placed.write.partitionBy(RANGE).parquet(f"{root}/rows")
    index = RankIndex(spark, root, df.schema, 0)
    counts = index._rows().groupBy(RANGE).agg(F.count(F.lit(1)).alias("rows"))
    # One row per range: small whatever the table holds, so one task may number them.
    running = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("rows").over(running), F.lit(0)))
    starts.coalesce(1).write.parquet(f"{root}/starts")
    total = index.starts().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    return RankIndex(spark, root, df.schema, total)
