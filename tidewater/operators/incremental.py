"""Incremental loads: high-water mark, absent rows, days still to load."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def high_water_mark(df: DataFrame, ts_col: str, alias: str = "high_water_day") -> DataFrame:
    """Newest day present (E07): one partial max per task, one row out."""
    return df.agg(F.to_date(F.max(F.col(ts_col))).alias(alias))


def absent_rows(candidates: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates whose key is not loaded yet (G01): a left-anti join, so an
    append of the result never duplicates a key that is already present.

    The loaded keys are de-duplicated first (a partial aggregate before the
    shuffle), so a key repeated in a third of the loaded rows reaches the
    join once.
    """
    return candidates.join(existing.select(*keys).distinct(), on=list(keys), how="left_anti")


def days_to_load(
    loaded: DataFrame,
    ts_col: str,
    until: _dt.date,
    lookback_months: int = 12,
    alias: str = "missing_day",
) -> DataFrame:
    """Calendar days after the newest loaded day up to ``until`` (inclusive).

    The high-water mark alone decides, so gaps before it are not loaded again
    and one aggregate over ``ts_col`` is all that is read.  With nothing loaded
    the range is the ``lookback_months`` before ``until``, both ends included;
    it is empty when the newest day has reached ``until``.
    """
    end = F.lit(until)
    start = F.coalesce(F.date_add(F.col("newest"), 1), F.add_months(end, -lookback_months))
    days = F.when(start <= end, F.sequence(start, end, F.expr("INTERVAL 1 DAY")))
    return high_water_mark(loaded, ts_col, "newest").select(F.explode(days).alias(alias))
