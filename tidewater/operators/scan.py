"""Scan with an optional filter and projection.

The reference builds a source query text (``FOR .. FILTER .. RETURN``); here
the filter and projection are plain DataFrame steps that Catalyst pushes
into the source (``PushedFilters`` / ``ReadSchema``).  Both blank means a
full scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def filtered_scan(df: DataFrame, condition: str | None = None, projection: Sequence[str] | None = None) -> DataFrame:
    if condition and condition.strip():
        df = df.filter(condition)
    if projection:
        cols = [c for c in projection if c and c.strip()]
        if cols:
            df = df.selectExpr(*cols)
    return df
