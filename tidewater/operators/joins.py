"""Join kinds by name and a join that never duplicates columns.

Strategy (broadcast / shuffled hash / sort-merge) is left to Catalyst and
AQE: a side is broadcast only when its estimated or, under AQE, measured
size is below the configured threshold.  Cross joins are refused: they emit
every pair and grow with the product of both inputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted join names and the kind each one means.
JOIN_KINDS: dict[str, str] = {
    "inner": "inner",
    "full": "full_outer",
    "full_outer": "full_outer",
    "left": "left_outer",
    "left_outer": "left_outer",
    "right": "right_outer",
    "right_outer": "right_outer",
    "left_semi": "left_semi",
    "left_anti": "left_anti",
}


def join_kind(how: str) -> str:
    key = how.lower()
    if key == "cross":
        raise ValueError("cross joins are not supported: they emit all pairs of both inputs")
    if key not in JOIN_KINDS:
        raise ValueError(f"unknown join kind {how!r}; use one of {sorted(JOIN_KINDS)}")
    return JOIN_KINDS[key]


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named key columns (USING form: keys appear once)."""
    return left.join(right, on=[on] if isinstance(on, str) else list(on), how=join_kind(how))


def join_keys(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Equi-join on differently named keys; both key columns are kept."""
    if len(left_on) != len(right_on) or not left_on:
        raise ValueError("left_on and right_on must be non-empty and of equal length")
    cond = [left[a] == right[b] for a, b in zip(left_on, right_on)]
    return left.join(right, on=cond, how=join_kind(how))


def new_columns(left_columns: Sequence[str], right_columns: Sequence[str]) -> list[str]:
    """Right-side names absent on the left, distinct, in right order."""
    seen: set[str] = set()
    out: list[str] = []
    for c in right_columns:
        if c not in left_columns and c not in seen:
            seen.add(c)
            out.append(c)
    return out


def join_without_duplicates(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join keeping every left column and only the right columns the left lacks.

    The right side is pruned to its keys plus those new columns before the
    join, so the shuffle carries nothing that is thrown away afterwards.
    """
    right_on = list(right_on or left_on)
    kind = join_kind(how)
    extra = [c for c in new_columns(left.columns, right.columns) if c not in right_on]
    keys = [f"__k{i}" for i in range(len(right_on))]
    slim = right.select(*[F.col(c).alias(k) for c, k in zip(right_on, keys)], *extra)
    cond = [left[a] == slim[k] for a, k in zip(left_on, keys)]
    joined = left.join(slim, on=cond, how=kind)
    if kind in ("left_semi", "left_anti"):
        return joined
    return joined.select(*[left[c] for c in left.columns], *[slim[c] for c in extra])
