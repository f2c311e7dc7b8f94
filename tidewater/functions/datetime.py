"""Time zone, month and formatting expressions.

All helpers work on ``TIMESTAMP_NTZ`` wall clocks with explicit zones and never
pass through the session zone: fields come from the wall clock itself, text is
built from its zone-free cast.  Only patterns with letters that ``render`` does
not know fall back to ``date_format``, which reads the wall clock in the session
zone and therefore moves it inside a daylight-saving gap of that zone.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone ids and output patterns used by the reports.
IST = "Asia/Kolkata"
UTC = "UTC"
ISO_DATE = "yyyy-MM-dd"
TIME_OF_DAY = "HH:mm:ss"
COMPACT_STAMP = "yyyyMMdd_HHmmssSSS"
YEAR_MONTH = "yyyy-MM"

#: Ids that are offsets themselves; every other id names a region, whose rules decide.
FIXED_OFFSET = re.compile(r"Z|[+-]\d{1,2}(:?\d{2}(:?\d{2})?)?")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def convert_zone(ts: Column | str, source_zone: str, target_zone: str) -> Column:
    """Wall clock in ``source_zone`` -> wall clock in ``target_zone``."""
    return F.convert_timezone(F.lit(source_zone), F.lit(target_zone), _c(ts))


def ist_to_utc(ts: Column | str) -> Column:
    """IST local time -> UTC local time."""
    return convert_zone(ts, IST, UTC)


def utc_to_ist(ts: Column | str) -> Column:
    """UTC local time -> IST local time."""
    return convert_zone(ts, UTC, IST)


def month_start(ts: Column | str) -> Column:
    """First instant of the month."""
    return F.trunc(to_date(ts), "month").cast("timestamp_ntz")


def month_end(ts: Column | str) -> Column:
    """23:59:59 on the last day of the month."""
    return F.timestamp_add("SECOND", F.lit(86_399), F.last_day(to_date(ts)).cast("timestamp_ntz"))


def trim_time(ts: Column | str) -> Column:
    """Midnight of the same day."""
    return to_midnight(ts)


def to_midnight(d: Column | str) -> Column:
    """Date -> timestamp at midnight; NULL stays NULL."""
    return _c(d).cast("date").cast("timestamp_ntz")


def to_date(ts: Column | str) -> Column:
    """Timestamp -> date; NULL stays NULL."""
    return F.to_date(_c(ts))


_RUNS_OF_LETTERS = re.compile(r"'((?:[^']|'')*)'|(([A-Za-z])\3*)|([^A-Za-z']+)")


def _field(letter: str, width: int, ts: Column) -> Column | None:
    """One numeric pattern field of a wall clock, None if ``render`` does not know it."""

    def number(value: Column) -> Column:
        text = value.cast("string")
        return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)

    if letter in "yu":
        return F.lpad((F.year(ts) % 100).cast("string"), 2, "0") if width == 2 else number(F.year(ts))
    if letter == "S":
        return F.substring(_fraction_digits(ts), 1, width)
    known = {"M": F.month, "d": F.day, "H": F.hour, "m": F.minute, "s": F.second}
    return number(known[letter](ts)) if letter in known and width <= 2 else None


def _fraction_digits(ts: Column) -> Column:
    """The second's fraction as nine digits."""
    whole = F.substring_index(ts.cast("string"), ".", -1)
    return F.rpad(F.when(ts.cast("string").contains("."), whole).otherwise(F.lit("")), 9, "0")


def render(ts: Column | str, pattern: str) -> Column:
    """A wall clock (or date) by a pattern of y u M d H m s S, literals and quoted text, without any zone.

    Patterns with other letters (names of days or months, ...) go to
    ``date_format``; see the module text for what that means in a gap.
    """
    clock = _c(ts).cast("timestamp_ntz")
    parts, at = [], 0
    for m in _RUNS_OF_LETTERS.finditer(pattern):
        if m.start() != at:
            raise ValueError(f"unbalanced quote in pattern {pattern!r}")
        at = m.end()
        if m.group(3):
            part = _field(m.group(3), len(m.group(2)), clock)
            if part is None:
                return F.date_format(_c(ts), pattern)
            parts.append(part)
        else:
            parts.append(F.lit(m.group(4) if m.group(4) is not None else m.group(1).replace("''", "'") or "'"))
    if at != len(pattern):
        raise ValueError(f"unbalanced quote in pattern {pattern!r}")
    # An all-literal pattern of a NULL value is NULL too.
    return F.when(clock.isNotNull(), F.concat(*parts, F.lit("")))


def iso_local(ts: Column | str) -> Column:
    """``2024-02-10T20:00:00.1234``: as many digits of the fraction as it has, none for a whole second."""
    return F.translate(_c(ts).cast("timestamp_ntz").cast("string"), " ", "T")


def format_date(d: Column | str, pattern: str = ISO_DATE) -> Column:
    """Date text, ISO by default."""
    return render(d, pattern)


def format_date_time(ts: Column | str, pattern: str | None = None) -> Column:
    """Wall-clock text, ISO with the fraction the value has by default."""
    return iso_local(ts) if pattern is None else render(ts, pattern)


def offset_text(seconds: Column) -> Column:
    """``Z``, ``+05:30`` or, with odd seconds, ``+05:53:28``."""
    size = F.abs(seconds).cast("int")

    def two(value: Column) -> Column:
        return F.lpad(value.cast("int").cast("string"), 2, "0")

    text = F.concat(F.when(seconds < 0, "-").otherwise("+"), two(F.floor(size / 3600)), F.lit(":"), two(F.floor(size / 60) % 60))
    odd = F.when(size % 60 != 0, F.concat(F.lit(":"), two(size % 60))).otherwise(F.lit(""))
    return F.when(seconds == 0, F.lit("Z")).otherwise(F.concat(text, odd))


def clock_seconds(ts: Column | str) -> Column:
    """Seconds of a wall clock since 1970-01-01 00:00, by its own fields (a difference of clocks would go through the session zone)."""
    c = _c(ts)
    return F.unix_date(to_date(c)).cast("long") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60 + F.second(c)


def zone_offset(ts_utc: Column | str, zone: str) -> Column:
    """The offset of ``zone`` at the UTC instant ``ts_utc``, daylight saving and old local mean times included."""
    return offset_text(clock_seconds(convert_zone(ts_utc, UTC, zone)) - clock_seconds(ts_utc))


def _suffix(ts_utc: Column | str, zone: str) -> Column:
    """Offset, and the zone id in brackets unless it is an offset itself."""
    offset = zone_offset(ts_utc, zone)
    return offset if FIXED_OFFSET.fullmatch(zone) else F.concat(offset, F.lit(f"[{zone}]"))


def format_utc_offset(ts: Column | str) -> Column:
    """UTC wall clock as an ISO instant with a ``Z`` offset."""
    return F.concat(iso_local(ts), F.lit("Z"))


def format_offset(ts: Column | str, offset: str, pattern: str | None = None) -> Column:
    """A wall clock that was read at a fixed ``offset`` (I11): ISO with that offset, or by ``pattern``."""
    if not FIXED_OFFSET.fullmatch(offset):
        raise ValueError(f"not an offset: {offset!r}")
    if pattern is not None:
        return render(ts, pattern)
    return F.concat(iso_local(ts), zone_offset(convert_zone(ts, offset, UTC), offset))


def format_zoned(ts: Column | str, zone: str, pattern: str | None = None) -> Column:
    """A wall clock of ``zone`` (I11): ISO with offset and ``[zone]``, or by ``pattern``.

    A clock inside a gap of the zone is moved behind it, one that occurs twice
    takes the earlier offset, as a zoned date-time of that clock does.
    """
    return convert_and_format(convert_zone(ts, zone, UTC), zone, pattern)


def convert_and_format(ts_utc: Column | str, zone: str, pattern: str | None = None) -> Column:
    """A UTC instant as the wall clock of ``zone`` (I12): ISO with offset and, for a region, ``[zone]``, or by ``pattern``."""
    local = convert_zone(ts_utc, UTC, zone)
    return render(local, pattern) if pattern is not None else F.concat(iso_local(local), _suffix(ts_utc, zone))


def format_with_offset(ts_utc: Column | str, zone: str) -> Column:
    """A UTC instant as the wall clock of ``zone`` with its offset and no zone id."""
    return F.concat(iso_local(convert_zone(ts_utc, UTC, zone)), zone_offset(ts_utc, zone))


def format_time(ts: Column | str) -> Column:
    """Time of day ``HH:mm:ss``."""
    return render(ts, TIME_OF_DAY)


def compact_stamp(ts: Column | str) -> Column:
    """``yyyyMMdd_HHmmssSSS`` stamp."""
    return render(ts, COMPACT_STAMP)


def year_month(ts: Column | str) -> Column:
    return render(ts, YEAR_MONTH)


def previous_year_month(ts: Column | str) -> Column:
    """Month before the one of ``ts`` as ``yyyy-MM``."""
    return year_month(F.add_months(F.to_date(_c(ts)), -1))


def now_in_zone(zone: str = IST) -> Column:
    """The current wall clock in ``zone`` as TIMESTAMP_NTZ.

    ``current_timestamp`` is read once per query, so every row sees the same
    instant; the conversion starts from the session zone, which is how Spark
    renders that instant.
    """
    return F.convert_timezone(None, F.lit(zone), F.current_timestamp())


def today_in_zone(zone: str = IST) -> Column:
    """Today's date in ``zone``."""
    return F.to_date(now_in_zone(zone))


def current_month_in_zone(zone: str = IST) -> Column:
    """This month in ``zone`` as ``yyyy-MM``."""
    return year_month(now_in_zone(zone))


def wall_clock_literal(value: _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal holding exactly ``value``'s wall clock.

    ``F.lit(datetime)`` would make a zoned literal read in the Python
    process's zone; casting that to NTZ shifts it by the session zone.
    Going through text avoids both zones.
    """
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def zoned_literal(value: _dt.datetime) -> Column:
    """A TIMESTAMP literal for ``value`` read as a wall clock in the session zone."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def month_range(month: str) -> tuple[_dt.datetime, _dt.datetime]:
    """``'YYYY-MM'`` -> [first instant, first instant of next month).

    Used to turn the reference's textual prefix filter into a range a Parquet
    scan can push down.
    """
    year, mon = parse_year_month(month)
    start = _dt.datetime(year, mon, 1)
    end = _dt.datetime(year + (mon == 12), mon % 12 + 1, 1)
    return start, end


def parse_year_month(month: str) -> tuple[int, int]:
    if not isinstance(month, str) or len(month) != 7 or month[4] != "-":
        raise ValueError(f"month must be 'YYYY-MM', got {month!r}")
    year, mon = int(month[:4]), int(month[5:])
    if not 1 <= mon <= 12:
        raise ValueError(f"month out of range: {month!r}")
    return year, mon


def current_year_month(zone: str = IST, today: _dt.date | None = None) -> str:
    """This month in ``zone`` (I04); ``today`` pins it for repeatable runs."""
    if today is None:
        from zoneinfo import ZoneInfo

        today = _dt.datetime.now(ZoneInfo(zone)).date()
    return f"{today.year:04d}-{today.month:02d}"
