"""Update-mode sink: changed keys replace their rows in a bucketed, versioned table.

A row belongs to one of ``buckets`` folders by a hash of its key.  A micro-batch
reads the buckets that its keys fall into, puts its rows in place of theirs,
writes those buckets into new folders and then commits a manifest, one small
file that names the folder of every bucket.  The other buckets are not touched,
a reader sees either the old manifest or the new one, and a micro-batch that is
replayed after a failure puts the same rows in place again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import path_exists

BUCKET = "_bucket"
_MANIFEST = "bucket INT, folder STRING, version BIGINT"


def _manifest(spark: SparkSession, root: str) -> tuple[int, dict[int, str]]:
    """(newest version, bucket -> folder); (0, {}) for a table without any."""
    if not path_exists(spark, f"{root}/manifest"):
        return 0, {}
    entries = spark.read.schema(_MANIFEST).json(f"{root}/manifest")
    newest = entries.agg(F.max("version").alias("v")).first()["v"]
    if newest is None:
        return 0, {}
    # At most one row per bucket.
    return newest, {r["bucket"]: r["folder"] for r in entries.filter(F.col("version") == newest).collect()}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_upserted(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The table as its newest manifest has it; empty before the first batch."""
    folders = _manifest(spark, root)[1].values()
    return spark.read.schema(schema).parquet(*sorted(folders)) if folders else spark.createDataFrame([], schema)


def upsert_writer(root: str, keys: Sequence[str], buckets: int = 16, keep_versions: int = 3) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body for ``update`` mode: rows of a batch replace the rows with their key.

    Keys must be unique within a batch, as the changed groups of an aggregation
    are; NULL is a key like any other.  A bucket should fit a task: raise
    ``buckets`` with the table (it must not change afterwards).  The newest
    ``keep_versions`` manifests and their folders stay for readers that have
    them open.  One stream writes to one table.
    """
    root = root.rstrip("/")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = batch.withColumn(BUCKET, bucket_of(keys, buckets)).persist()
        try:
            touched = [r[BUCKET] for r in changed.select(BUCKET).distinct().collect()]  # at most ``buckets``
            if not touched:
                return
            version, folders = _manifest(spark, root)
            held = [folders[b] for b in sorted(touched) if b in folders]
            rows = changed
            if held:
                old = spark.read.schema(batch.schema).parquet(*held).withColumn(BUCKET, bucket_of(keys, buckets))
                new = changed.select(BUCKET, *[F.col(k).alias(f"_new_{k}") for k in keys])
                same = [old[BUCKET] == new[BUCKET], *[old[k].eqNullSafe(new[f"_new_{k}"]) for k in keys]]
                rows = old.join(new, same, "left_anti").unionByName(changed)
            data = f"{root}/data/{uuid.uuid4().hex}"
            rows.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(data)
            folders |= {b: f"{data}/{BUCKET}={b}" for b in touched}
            # Readers take the newest version they can list: this one small file is the commit.
            entries = spark.createDataFrame(sorted(folders.items()), "bucket INT, folder STRING")
            entries.coalesce(1).write.mode("overwrite").json(f"{root}/manifest/version={version + 1}")
            _drop_older(spark, root, version + 1 - keep_versions)
        finally:
            changed.unpersist()

    return write_batch


def _drop_older(spark: SparkSession, root: str, version: int) -> None:
    """Manifest ``version`` and the folders that only it and older ones name."""
    if version < 1:
        return
    entries = spark.read.schema(_MANIFEST).json(f"{root}/manifest")
    named = entries.groupBy("folder").agg(F.max("version").alias("last"))
    for r in named.filter(F.col("last") <= version).collect():  # buckets of a few versions
        _delete(spark, r["folder"])
    _delete(spark, f"{root}/manifest/version={version}")
