"""Latest row overall and per group.

Per-group "latest" is aggregation, not a window: it combines map-side, so a
group holding a third of all rows never lands whole in one task.  Where the
ordering keys tell all rows of a group apart, each key's maximum is a hash
aggregate over fixed-width values; a maximum over whole rows would have to sort
them, since a row is no value that a hash aggregate can update in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_one(df: DataFrame, order_desc: Sequence[str]) -> DataFrame:
    """The single newest row by ``order_desc`` (F04); a top-k plan, one row per task."""
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in order_desc]).limit(1)


def latest_per_group(df: DataFrame, group: str, order_desc: Sequence[str], unique: bool = False) -> DataFrame:
    """One row per ``group`` value: the one with the greatest ``order_desc`` tuple.

    NULL keys order lowest, as in ``desc nulls last``; a NULL group is a group.

    ``unique``: no two rows of a group agree in all keys.  Then the greatest
    first key of every group is found, the greatest second key among the rows
    that have it, and so on, and the rows that have all of them are taken.  Only
    the group and the keys are read for that, one row per group meets the rows
    again.  Otherwise rows that agree are told apart by their remaining columns,
    so the result is deterministic, at the price of sorting whole rows.
    """
    if unique:
        best = None
        for i, key in enumerate(order_desc):
            held = list(order_desc[:i])
            rows = df if best is None else _reaching(df, best, group, held)
            best = rows.groupBy(group, *held).agg(F.max(key).alias(key))
        return _reaching(df, best, group, order_desc).select(*df.columns)
    rest = [c for c in df.columns if c != group and c not in order_desc]
    packed = F.struct(*[F.col(c) for c in (*order_desc, *rest)]).alias("_row")
    best = df.groupBy(group).agg(F.max(packed).alias("_row"))
    return best.select(group, *[F.col(f"_row.{c}").alias(c) for c in (*order_desc, *rest)]).select(*df.columns)


def _reaching(df: DataFrame, best: DataFrame, group: str, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose ``keys`` are those of their group in ``best`` (one row per group)."""
    names = [group, *keys]
    wanted = best.select(*[F.col(c).alias(f"_best_{c}") for c in names])
    return df.join(wanted, [df[c].eqNullSafe(wanted[f"_best_{c}"]) for c in names], "left_semi")
