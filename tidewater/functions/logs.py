"""Log line layout and error-line extraction.

The same expressions serve batch frames and streaming frames, so the parser
step is a plain ``DataFrame -> DataFrame`` function usable with ``transform``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The error-line pattern and its group numbers.  The line must
# start with the stamp (the look-behind on ``^``); group 4 starts at the LAST
# colon (greedy ``.*`` before it) and keeps it.
ERROR_LINE_PATTERN = r"(?<=^)(\S+T\S+)(\s+ERROR\s+\d+\s+---\s+\[([a-zA-Z0-9-]+)\].*)(:.*)"
DATETIME_GROUP = 1
APPLICATION_GROUP = 3
MESSAGE_GROUP = 4

# Fixed value: the layout of a log line.  ``render_log_line`` builds the same
# text with one concat (tests check it against this template).
LOG_TEMPLATE = "${timestamp} ${level} ${pid} --- [${application}] [  ${thread}] ${class}     : ${message}"
LOG_LINE_COLUMN = "log_line"


def render_log_line(
    stamp: Column,
    level: Column,
    pid: Column,
    application: Column,
    thread: Column,
    clazz: Column,
    message: Column,
) -> Column:
    """Structured fields -> one log line (I25, the inverse of the parser)."""
    return F.concat(
        stamp, F.lit(" "),
        level, F.lit(" "),
        pid.cast("string"), F.lit(" --- ["),
        application, F.lit("] [  "),
        thread, F.lit("] "),
        clazz, F.lit("     : "),
        message,
    )


def payload_to_text(df: DataFrame, source: str = "value", target: str = LOG_LINE_COLUMN) -> DataFrame:
    """Binary message payload -> text column."""
    return df.selectExpr(f"CAST({source} AS STRING) AS {target}")


def is_error_line(line: Column | str = LOG_LINE_COLUMN, pattern: str = ERROR_LINE_PATTERN) -> Column:
    """Row filter by regular expression.

    With the default pattern a plain substring test runs first: every match
    contains ``ERROR``, so lines without it never reach the regular expression.
    """
    c = F.col(line) if isinstance(line, str) else line
    if pattern == ERROR_LINE_PATTERN:
        return c.contains("ERROR") & c.rlike(pattern)
    return c.rlike(pattern)


#: Stands before every group of a matching line; ``_ESCAPES`` keeps it out of the line itself.
_SEPARATOR = "\u0000"
_ESCAPES = (("\u0001", "\u0001\u0002"), ("\u0000", "\u0001\u0003"))


def error_groups(line: Column) -> Column:
    """An array with the date, application and message of the line, or an empty array; one run of the pattern.

    The match, and what follows it on further lines, is replaced by its groups
    with a separator before each; a line that does not match stays as it is and
    has no separator.  Separators in the line are escaped first, which the
    pattern cannot tell from the characters themselves: neither is a space, a
    digit, a letter, a bracket or a colon.
    """
    held = line.contains(_SEPARATOR) | line.contains(_ESCAPES[0][0])
    escaped = line
    for character, stand_in in _ESCAPES:
        escaped = F.replace(escaped, F.lit(character), F.lit(stand_in))

    def plain(group: Column) -> Column:
        for character, stand_in in reversed(_ESCAPES):
            group = F.replace(group, F.lit(stand_in), F.lit(character))
        return group

    groups = "".join(f"{_SEPARATOR}${n}" for n in (DATETIME_GROUP, APPLICATION_GROUP, MESSAGE_GROUP))
    marked = F.regexp_replace(F.when(held, escaped).otherwise(line), f"{ERROR_LINE_PATTERN}(?s:.*)", groups)

    def parts(text: Column) -> Column:
        return F.slice(F.split(text, _SEPARATOR), 2, 3)

    def unescaped(found: Column) -> Column:
        return F.when(held, F.transform(found, plain)).otherwise(found)

    return F.transform(F.filter(F.transform(F.array(marked), parts), lambda p: F.size(p) == 3), unescaped)


def parse_error_lines(
    lines: DataFrame,
    line_column: str = LOG_LINE_COLUMN,
    pattern: str = ERROR_LINE_PATTERN,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Keep matching lines and extract datetime / application / message.

    Pure per-row expressions: a narrow stage, no shuffle, runs unchanged on a
    streaming frame.  NULL lines drop out of the filter.  With the default
    pattern a line that contains ``ERROR`` runs through it once; an own pattern,
    which may match anywhere, is tested and then read group by group.
    """
    line = F.col(line_column)
    names = ("datetime", "application", "error_message")
    if pattern == ERROR_LINE_PATTERN:
        # The array is made once, by the generator; a filter on it would be pushed below and make it again.
        found = lines.filter(line.contains("ERROR")).select(*keep, F.explode(error_groups(line)).alias("_groups"))
        return found.select(*keep, *[F.col("_groups")[i].alias(n) for i, n in enumerate(names)])
    return lines.filter(is_error_line(line, pattern)).select(
        *keep, *[F.regexp_extract(line, pattern, g).alias(n) for g, n in zip((DATETIME_GROUP, APPLICATION_GROUP, MESSAGE_GROUP), names)]
    )
