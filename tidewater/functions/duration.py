"""Durations as milliseconds, split into parts and rendered as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.datetime import clock_seconds

MS_PER_SECOND = 1000
MS_PER_MINUTE = 60 * MS_PER_SECOND
MS_PER_HOUR = 60 * MS_PER_MINUTE

# The unit labels of the duration text, each with its spacing.
HOURS_LABEL = " Hours "
MINUTES_LABEL = " Minutes "
SECONDS_LABEL = " Seconds "
MILLIS_LABEL = " Milli Seconds"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _micros(ts: Column) -> Column:
    """Microseconds within the second."""
    return (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long") % 1_000_000


def duration_ms(start: Column | str, end: Column | str) -> Column:
    """Whole milliseconds from ``start`` to ``end``; NULL while ``end`` is NULL.

    A negative span is an error, as in the reference (I15).  Between wall
    clocks (NTZ) it is the span of the clocks: no session zone, no daylight saving.
    """
    a, b = _c(start), _c(end)
    micros = (clock_seconds(b) - clock_seconds(a)) * 1_000_000 + _micros(b) - _micros(a)
    # typeof() is known before any row is read, so one of the two branches remains.
    clocks = (F.typeof(a) == "timestamp_ntz") & (F.typeof(b) == "timestamp_ntz")
    ms = F.when(clocks, (micros - micros % 1000) / 1000).otherwise(F.timestamp_diff("MILLISECOND", a, b)).cast("long")
    return F.when(ms < 0, F.raise_error(F.lit("duration must not be negative"))).otherwise(ms)


def _div(a: Column, b: int) -> Column:
    # Integer division of a non-negative long; no floating point.
    return (a - a % b) / b


def duration_parts(ms: Column | str) -> dict[str, Column]:
    """Hours (unbounded), minutes, seconds, milliseconds by successive division."""
    ms = _c(ms).cast("long")
    return {
        "hours": _div(ms, MS_PER_HOUR).cast("long"),
        "minutes": _div(ms % MS_PER_HOUR, MS_PER_MINUTE).cast("long"),
        "seconds": _div(ms % MS_PER_MINUTE, MS_PER_SECOND).cast("long"),
        "millis": (ms % MS_PER_SECOND).cast("long"),
    }


def duration_text(ms: Column | str) -> Column:
    """``3 Hours 34 Minutes 23 Seconds 113 Milli Seconds`` (I16).

    Zero parts are left out, so a zero duration is the empty string and a
    trailing blank stays when the millisecond part is zero.
    """
    p = duration_parts(ms)

    def part(value: Column, label: str) -> Column:
        return F.when(value != 0, F.concat(value.cast("string"), F.lit(label))).otherwise(F.lit(""))

    text = F.concat(
        part(p["hours"], HOURS_LABEL),
        part(p["minutes"], MINUTES_LABEL),
        part(p["seconds"], SECONDS_LABEL),
        part(p["millis"], MILLIS_LABEL),
    )
    return F.when(_c(ms).isNotNull(), text)


def compose_ms(hours: Column | str, minutes: Column | str, seconds: Column | str, millis: Column | str) -> Column:
    """Parts back to milliseconds."""
    return ((_c(hours) * 60 + _c(minutes)) * 60 + _c(seconds)) * 1000 + _c(millis)
