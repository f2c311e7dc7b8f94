"""Error-log extraction job, batch side.

The parser is a ``DataFrame -> DataFrame`` step, so the streaming job
(``tidewater.streaming.error_stream``) applies exactly the same function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.logs import LOG_LINE_COLUMN, parse_error_lines, payload_to_text

ParserStep = Callable[[DataFrame], DataFrame]


def regex_parser(pattern: str | None = None) -> ParserStep:
    """The default, replaceable parser step."""
    if pattern is None:
        return parse_error_lines
    return lambda lines: parse_error_lines(lines, pattern=pattern)


def extract_errors(raw: DataFrame, parser: ParserStep | None = None, payload_column: str | None = None) -> DataFrame:
    """Raw records -> error table; ``payload_column`` is a binary message value."""
    lines = payload_to_text(raw, payload_column) if payload_column else raw.select(LOG_LINE_COLUMN)
    return lines.transform(parser or regex_parser())


def error_counts(errors: DataFrame) -> DataFrame:
    """Errors per application; partial aggregation before the shuffle."""
    return errors.groupBy("application").agg(F.count(F.lit(1)).alias("error_count"))
