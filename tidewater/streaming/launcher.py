"""Start, wait, restart and stop streaming queries.

A restarted query resumes from its checkpoint, so the restart loop gives
at-least-once delivery and, with the idempotent sinks, exactly-once results.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger(__name__)


class QueryGroup:
    """Queries started together; ``stop_all`` goes on when one fails to stop."""

    def __init__(self) -> None:
        self.queries: list[StreamingQuery] = []

    def add(self, *queries: StreamingQuery) -> None:
        self.queries.extend(queries)

    def await_all(self, timeout_s: float | None = None) -> None:
        for q in self.queries:
            if timeout_s is None:
                q.awaitTermination()
            else:
                q.awaitTermination(timeout_s)

    def stop_all(self) -> list[str]:
        """Stop every query; returns the errors of those that failed to stop."""
        errors: list[str] = []
        for q in self.queries:
            try:
                q.stop()
            except Exception as e:  # noqa: BLE001 - keep stopping the others
                errors.append(f"{q.name or q.id}: {e}")
                log.warning("failed to stop query %s: %s", q.name or q.id, e)
        return errors


def start_once(start: Callable[[], StreamingQuery], timeout_s: float | None = None) -> StreamingQuery | None:
    """Start and wait, without retry; a failure is logged and returned as None."""
    try:
        q = start()
        q.awaitTermination(timeout_s) if timeout_s is not None else q.awaitTermination()
        return q
    except StreamingQueryException as e:
        log.error("streaming query failed: %s", e)
        return None


def run_with_restart(
    start: Callable[[], StreamingQuery],
    max_attempts: int | None = None,
    delay_s: float = 5.0,
    timeout_s: float | None = None,
    on_failure: Callable[[int, Exception], None] | None = None,
) -> StreamingQuery:
    """Start and wait; on failure start again after ``delay_s``.

    ``max_attempts=None`` retries without limit, as the reference does.  Each
    attempt calls ``start`` again, which resumes from the checkpoint.
    """
    attempt = 0
    while True:
        attempt += 1
        try:
            q = start()
            if timeout_s is None:
                q.awaitTermination()
            else:
                q.awaitTermination(timeout_s)
            return q
        except StreamingQueryException as e:
            if on_failure is not None:
                on_failure(attempt, e)
            log.warning("streaming attempt %d failed: %s", attempt, e)
            if max_attempts is not None and attempt >= max_attempts:
                raise
            time.sleep(delay_s)
