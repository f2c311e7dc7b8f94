"""Paging over a sorted frame.

``page`` uses offset + limit, planned as a bounded top-k
(TakeOrderedAndProject keeps offset + size rows per task).  For deep pages
``page_after`` filters on the last key seen (keyset paging), so the cost does
not grow with the page number.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.datetime import wall_clock_literal


def _sort_cols(keys: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(k).asc_nulls_first() if asc else F.col(k).desc_nulls_last() for k, asc in keys]


def page(
    df: DataFrame,
    number: int,
    size: int,
    keys: Sequence[tuple[str, bool]],
) -> DataFrame:
    """Rows of page ``number`` (0-based) of ``size`` rows.

    ``keys`` is a list of (column, ascending); its last entry must be unique
    so pages are repeatable.  Any depth is served; the cost grows with it (the
    final merge takes ``offset + size`` rows of every task), so a walk through
    many pages is cheaper with ``page_after``.
    """
    if number < 0 or size < 0:
        raise ValueError("page number and size must not be negative")
    ordered = df.orderBy(*_sort_cols(keys))
    return ordered.offset(number * size).limit(size) if number else ordered.limit(size)


def _key_literal(df: DataFrame, column: str, value) -> Column:
    """A literal for a key value as collected from ``column``.

    Wall-clock (NTZ) keys come back as naive datetimes; they are rebuilt
    from text so no time zone can shift them.
    """
    if isinstance(df.schema[column].dataType, T.TimestampNTZType) and isinstance(value, _dt.datetime):
        return wall_clock_literal(value)
    return F.lit(value)


def page_after(df: DataFrame, size: int, keys: Sequence[tuple[str, bool]], last: Sequence | None) -> DataFrame:
    """The ``size`` rows that follow the row whose key values are ``last`` (keyset paging).

    The keys must be non-NULL: a comparison with NULL is unknown, so such
    rows would never be reached by a walk.
    """
    if last is not None:
        # (k1, k2, ...) strictly after ``last`` in the sort order:
        # k1 beyond, or k1 equal and k2 beyond, or ...
        values = [_key_literal(df, k, v) for (k, _), v in zip(keys, last)]
        cond = None
        for i, (k, asc) in enumerate(keys):
            step = F.col(k) > values[i] if asc else F.col(k) < values[i]
            for j in range(i):
                step = step & (F.col(keys[j][0]) == values[j])
            cond = step if cond is None else cond | step
        df = df.filter(cond)
    return df.orderBy(*_sort_cols(keys)).limit(size)


def page_facts(total: Column, number: int, size: int) -> list[Column]:
    """Page envelope numbers from a total row count."""
    n, s = F.lit(number), F.lit(size)
    pages = F.lit(0) if size == 0 else F.ceil(total.cast("double") / F.lit(float(size))).cast("int")
    has_next = (n + 1) < pages
    has_previous = n > 0
    return [
        total.alias("total_records"),
        n.alias("current_page"),
        s.alias("page_size"),
        pages.alias("total_pages"),
        has_next.alias("has_next"),
        has_previous.alias("has_previous"),
        (~has_previous).alias("is_first"),
        (~has_next).alias("is_last"),
        F.format_string("Page %s of %d", F.when(total == 0, F.lit(0)).otherwise(n + 1), pages).alias("header"),
        (n * s).alias("first_result"),
        s.alias("max_results"),
    ]


def page_summary(df: DataFrame, number: int, size: int) -> DataFrame:
    """One row: count the frame and derive the page facts."""
    return df.agg(F.count(F.lit(1)).alias("_n")).select(*page_facts(F.col("_n"), number, size))
