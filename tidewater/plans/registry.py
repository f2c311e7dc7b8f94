"""Named queries over the test tables, each with its DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class RegisteredQuery:
    name: str
    fn: QueryFn
    oracle: str | None
    rows: str  # SURVEY section 2 ids covered


REGISTRY: dict[str, RegisteredQuery] = {}


def register(name: str, rows: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = RegisteredQuery(name, fn, oracle, rows)
        return fn

    return deco


def load_all() -> dict[str, RegisteredQuery]:
    # Importing the modules fills REGISTRY.
    from tidewater.plans import (  # noqa: F401
        queries_functions,
        queries_io,
        queries_logs,
        queries_relational,
        queries_runs,
        queries_sales,
        queries_streaming,
    )

    return REGISTRY
