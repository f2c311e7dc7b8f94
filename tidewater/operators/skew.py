"""Joins that stay balanced when one key holds a large share of the rows.

AQE splits a skewed shuffle partition only on a side it may duplicate the other
side for: both sides of an inner join, but only the row-preserved side of an
outer join.  ``customers LEFT JOIN orders`` with one customer owning a third of
the orders therefore sends that third to one task.

Outer joins here read each side once and deal the hot keys themselves:

* a frequent-items sketch (mergeable, bounded) over the keys of both sides names
  candidates, a count of those alone decides which are hot;
* rows of a hot key are dealt over slices of its own side by a hash of the row,
  and copied to every slice of the other side, so slice (i, j) joins part i of
  the left rows with part j of the right ones, each pair exactly once;
* a copied row that finds no partner in one slice may have found it in another.
  A copy is made only because the other side is hot in that key, so it has a
  partner: its NULL-padded rows are dropped;
* rows with a NULL key match nothing and are dealt over slices as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.joins import join_keys, join_kind

#: Items the sketch tracks, candidates it may name, and partial sketches merged in the last step.
TRACKED, CANDIDATES, BUCKETS = 8192, 1024, 64
#: Fewer rows of a key than this are never worth slicing.
FEWEST_ROWS = 1000
#: More than the slices of any key; numbers a pair of slices.
SLICES = 1 << 30


def _distinct_keys(df: DataFrame, on: Sequence[str], prefix: str) -> tuple[DataFrame, list[str]]:
    names = [f"{prefix}{i}" for i in range(len(on))]
    keys = df.select(*[F.col(c).alias(n) for c, n in zip(on, names)]).dropna(subset=names)
    return keys.distinct(), names


def hot_keys(
    left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], rows_per_slice: int | None = None
) -> tuple[list[tuple], T.StructType, int]:
    """Keys with more than ``rows_per_slice`` rows on a side: (key..., left rows, right rows), their schema, the limit used.

    Only key columns are read.  The sketch is merged per bucket of tasks first,
    so its last step takes a fixed number of fixed-size sketches; it finds every
    key with more than some 1/2000 of all rows.  The limit defaults to twice an
    even share of the shuffle partitions.  The answer has at most ``CANDIDATES``
    rows and is exact for those.
    """
    names = [f"k{i}" for i in range(len(left_on))]

    def keys(df: DataFrame, on: Sequence[str], side: int) -> DataFrame:
        return df.select(*[F.col(c).alias(n) for c, n in zip(on, names)], F.lit(side).alias("side"))

    both = keys(left, left_on, 0).union(keys(right, right_on, 1)).dropna(subset=names)
    hashed = both.withColumn("h", F.xxhash64(*names)).withColumn("bucket", F.spark_partition_id() % BUCKETS)
    sketches = hashed.groupBy("bucket").agg(F.expr(f"approx_top_k_accumulate(h, {TRACKED})").alias("s"), F.count(F.lit(1)).alias("n"))
    # By a constant key: a combination of no sketches at all, as in a task without rows, is an error in Spark.
    merged = sketches.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {TRACKED})").alias("s"), F.sum("n").alias("n"))
    found = merged.select(F.expr(f"approx_top_k_estimate(s, {CANDIDATES})").alias("items"), "n").first()
    total = found["n"] if found else 0
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = rows_per_slice or max(2 * total // partitions, FEWEST_ROWS)
    schema = T.StructType([*[both.schema[n] for n in names], T.StructField("left_rows", T.LongType()), T.StructField("right_rows", T.LongType())])
    candidates = [i["item"] for i in (found["items"] if found else []) if i["count"] > limit]
    if not candidates:
        return [], schema, limit
    exact = hashed.filter(F.col("h").isin(candidates)).groupBy(*names).agg(
        F.count_if(F.col("side") == 0).alias("left_rows"), F.count_if(F.col("side") == 1).alias("right_rows")
    )
    hot = exact.filter(F.greatest("left_rows", "right_rows") > limit)
    return [tuple(r) for r in hot.collect()], schema, limit


def _dealt(df: DataFrame, on: Sequence[str], hot: DataFrame | None, side: str, spread: int) -> DataFrame:
    """``df`` with ``__{side}_cell``, the slice pair a row lies in (one copy per slice of the other side), and whether it is copied."""
    cell, copied = f"__{side}_cell", f"__{side}_copied"
    row = F.xxhash64(*df.columns)
    no_key = F.greatest(*[F.col(c).isNull().cast("int") for c in on], F.lit(0)) == 1
    alone = F.when(no_key, F.pmod(row, F.lit(spread))).otherwise(F.lit(0).cast("long"))
    if hot is None:
        return df.withColumns({cell: alone, copied: F.lit(False)})
    own, other = ("left", "right") if side == "left" else ("right", "left")
    names = [f"__{side}_k{i}" for i in range(len(on))]
    facts = hot.select(
        *[F.col(f"k{i}").alias(n) for i, n in enumerate(names)], F.col(f"{own}_rows").alias("__own"), F.col(f"{other}_rows").alias("__other")
    )
    # At most CANDIDATES rows.
    met = df.join(F.broadcast(facts), [df[c] == facts[n] for c, n in zip(on, names)], "left")
    mine = F.pmod(row, F.coalesce("__own", F.lit(1)))
    copies = met.select(*df.columns, mine.alias("__mine"), F.coalesce("__other", F.lit(1)).alias("__copies"))
    dealt = copies.withColumn("__theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    i, j = (F.col("__mine"), F.col("__theirs")) if side == "left" else (F.col("__theirs"), F.col("__mine"))
    return dealt.select(*df.columns, F.when(no_key, alone).otherwise(i * SLICES + j).alias(cell), (F.col("__copies") > 1).alias(copied))


def skew_safe_join(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str],
    how: str = "left",
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Equi-join of kind ``how`` with both key columns kept, as ``join_keys`` does, without a task that holds a hot key whole.

    Inner, semi and anti joins are Spark's own: AQE splits either side of the
    first, and the others see every key once on their right side.  For outer
    joins hot keys are looked up when this is called (two small jobs over the
    key columns).  Slices go by a hash of the whole row, so a retried task deals
    its rows as before; rows equal in every column stay together.
    """
    kind = join_kind(how)
    if kind == "inner":
        return join_keys(left, right, left_on, right_on, "inner")
    if kind in ("left_semi", "left_anti"):
        keys, names = _distinct_keys(right, right_on, "__r")
        return left.join(keys, [left[c] == keys[n] for c, n in zip(left_on, names)], kind)
    if len(left_on) != len(right_on) or not left_on:
        raise ValueError("left_on and right_on must be non-empty and of equal length")
    if set(left.columns) & set(right.columns):
        raise ValueError("column names of the two sides must differ")
    spark = left.sparkSession
    rows, schema, limit = hot_keys(left, right, left_on, right_on, rows_per_slice)
    hot = None
    if rows:
        slices = [(*r[:-2], max(1, -(-r[-2] // limit)), max(1, -(-r[-1] // limit))) for r in rows]
        hot = spark.createDataFrame(slices, schema)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a, b = _dealt(left, left_on, hot, "left", spread), _dealt(right, right_on, hot, "right", spread)
    joined = a.join(b, [*[a[x] == b[y] for x, y in zip(left_on, right_on)], a["__left_cell"] == b["__right_cell"]], kind)
    if hot is not None:
        # A copied row without a partner in this slice has one in another.
        alone = (F.col("__left_copied") & F.col("__right_copied").isNull()) | (F.col("__right_copied") & F.col("__left_copied").isNull())
        joined = joined.filter(~F.coalesce(alone, F.lit(False)))
    return joined.select(*[a[c] for c in left.columns], *[b[c] for c in right.columns])
