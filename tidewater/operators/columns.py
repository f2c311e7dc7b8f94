"""Column guards, projections, previews and NULL handling."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _flatten(names: tuple[str | Iterable[str], ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        if isinstance(name, str):
            out.append(name)
        else:
            out.extend(name)
    return out


def to_columns(*names: str | Iterable[str]) -> list[Column]:
    """Names (varargs or one collection) to column objects."""
    return [F.col(n) for n in _flatten(names)]


def project(df: DataFrame, *names: str | Iterable[str]) -> DataFrame:
    """Keep only the named columns; Catalyst prunes the scan to them."""
    require_columns(df, *_flatten(names))
    return df.select(*to_columns(*names))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail early unless every named column is present (C09, all)."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; frame has {df.columns}")
    return df


def require_any_column(df: DataFrame, *names: str) -> DataFrame:
    """Fail unless at least one named column is present (C09, one)."""
    if not any(n in df.columns for n in names):
        raise ValueError(f"none of {list(names)} present; frame has {df.columns}")
    return df


def require_absent(df: DataFrame, *names: str) -> DataFrame:
    """Fail if any named column is already present (C09, absent)."""
    clash = [n for n in names if n in df.columns]
    if clash:
        raise ValueError(f"columns {clash} must not exist yet")
    return df


def preview(df: DataFrame, n: int = 8, order_by: Iterable[str | Column] | None = None) -> DataFrame:
    """First ``n`` rows.

    With ``order_by`` the plan is a top-k (TakeOrderedAndProject): each
    partition keeps ``n`` rows and only those reach the final merge, so the
    cost does not depend on the table size beyond one scan.
    """
    if order_by is not None:
        df = df.orderBy(*order_by)
    return df.limit(n)


def log_preview(df: DataFrame, name: str, n: int = 8, enabled: bool = True) -> DataFrame:
    """Print the schema and the first ``n`` rows (C10), then return ``df`` unchanged.

    Opt-in: every preview runs the plan up to a limit, so keep it off in
    production jobs (the reference's three previews re-read their sources).
    """
    if enabled:
        print(f"== {name} ==")
        df.printSchema()
        df.show(n, truncate=False)
    return df


NULL_DROP_MODES = ("any", "all")


def drop_nulls(df: DataFrame, how: str = "any", subset: Iterable[str] | None = None) -> DataFrame:
    """Drop rows with NULLs in any / all of ``subset`` (C11)."""
    if how not in NULL_DROP_MODES:
        raise ValueError(f"how must be one of {NULL_DROP_MODES}, got {how!r}")
    return df.na.drop(how=how, subset=list(subset) if subset is not None else None)
