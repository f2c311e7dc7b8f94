"""Translate a missing data source into one clear error."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")


class ConnectorUnavailable(RuntimeError):
    """The connector's data source is not on the classpath of this session."""


def guarded(fmt: str, action: Callable[[], T]) -> T:
    try:
        return action()
    except Exception as e:  # noqa: BLE001 - rethrown with context
        text = str(e)
        if "DATA_SOURCE_NOT_FOUND" in text or "Failed to find data source" in text:
            raise ConnectorUnavailable(
                f"data source {fmt!r} is not available; add its package to spark.jars.packages"
            ) from e
        raise
