"""Row-count checks of outputs as a quality table.

``row_count_checks`` counts frames; ``CountedOutputs`` takes the counts from the
job that writes or reads the frames anyway, so nothing is computed twice.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def row_count_checks(checks: Mapping[str, tuple[DataFrame, int]]) -> DataFrame:
    """One row per check: name, row count, required minimum, passed.

    Each count is a partial + final aggregate; the one-row results are
    unioned, never joined.
    """
    if not checks:
        raise ValueError("at least one check is required")
    rows = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("check_name"),
            F.col("row_count"),
            F.lit(minimum).cast("long").alias("min_rows"),
            (F.col("row_count") >= minimum).alias("passed"),
        )
        for name, (df, minimum) in checks.items()
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


class CountedOutputs:
    """Row counts observed while frames pass through the job that uses them.

    ``watch`` a frame, let one action run over the frame it returns (a write, or
    a join that is written), then ask for ``checks``.  Each frame must be part
    of exactly one action; ``checks`` waits for it.  Counts are taken where the
    rows pass: a stage that Spark repeats after a lost executor may count its
    rows again, so compare with a minimum, not for equality.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._watched: dict[str, tuple[Observation, int]] = {}

    def watch(self, name: str, df: DataFrame, minimum: int) -> DataFrame:
        """``df`` as it is, counted under ``name``."""
        if name in self._watched:
            raise ValueError(f"check {name!r} is there already")
        seen = Observation(name)
        self._watched[name] = seen, minimum
        return df.observe(seen, F.count(F.lit(1)).alias("row_count"))

    def checks(self) -> DataFrame:
        """One row per check: name, row count, required minimum, passed."""
        if not self._watched:
            raise ValueError("at least one check is required")
        rows = [(name, seen.get["row_count"], minimum) for name, (seen, minimum) in self._watched.items()]
        table = self.spark.createDataFrame(rows, "check_name string, row_count long, min_rows long")
        return table.withColumn("passed", F.col("row_count") >= F.col("min_rows"))
