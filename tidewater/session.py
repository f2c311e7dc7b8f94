"""Session defaults and the shared scratch location.

Settings follow the reference jobs' intent (AQE on, compressed checkpoints) and
pin the SQL session time zone to UTC so textual date semantics are stable.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings that are safe to apply to an existing session.
SQL_DEFAULTS: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime-statistics-driven broadcast: AQE only converts a join to a
    # broadcast when the measured shuffle output of a side is below this.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(
    master: str | None = None,
    app_name: str = "tidewater",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    On a cluster leave ``master`` unset (spark-submit decides) and size
    ``shuffle_partitions`` to the data: AQE coalesces small partitions, so a
    high initial number is cheap and keeps each reducer's input bounded.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SQL_DEFAULTS)
    conf.update(
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.compress": "true",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
        }
    )
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    apply_sql_defaults(spark)
    return spark


def scale_settings(
    input_bytes: int,
    total_cores: int,
    partition_bytes: int = 256 * 1024 * 1024,
) -> dict[str, str]:
    """Partition sizing for a cluster run over ``input_bytes`` of input.

    Scan splits and shuffle partitions target ``partition_bytes`` each so a
    task's input fits executor memory without spilling much; AQE starts from
    that many shuffle partitions and coalesces the small ones.  At 100 TB and
    256 MB this is about 400k initial partitions, never fewer than 2 per core.
    """
    shuffle = max(2 * total_cores, -(-input_bytes // partition_bytes))
    size = f"{partition_bytes // (1024 * 1024)}MB"
    return {
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
    }


def apply_sql_defaults(spark: SparkSession, overrides: dict[str, str] | None = None) -> None:
    """Apply the runtime SQL settings to an existing session."""
    conf = dict(SQL_DEFAULTS)
    conf.update(overrides or {})
    for key, value in conf.items():
        spark.conf.set(key, value)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and points at shared storage;
    if it is missing there, this fails rather than fall back to a folder that
    only one machine sees.  Only in local mode (tests) is a folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: point it at shared storage (for example an s3a:// or hdfs:// folder)"
            )
        configured = tempfile.mkdtemp(prefix="tidewater-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, unique location below the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return "/".join([root, "tidewater", *parts, uuid.uuid4().hex])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, in whatever file system it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
