"""Registered scalar-function queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import datetime as D
from tidewater.functions import text as X
from tidewater.plans import views
from tidewater.plans.registry import register
from tidewater.sources.kafka import parse_json_payload


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events")


BERLIN, NEW_DELHI_OFFSET = "Europe/Berlin", "+05:30"


def _iso_sql(us: str) -> str:
    """ISO wall clock of epoch microseconds by plain arithmetic: as many digits of the fraction as there are."""
    day = f"strftime(make_timestamp({us} - {us} % 86400000000), '%Y-%m-%d')"
    two = "lpad(CAST({} AS VARCHAR), 2, '0')"
    clock = " || ':' || ".join(
        two.format(x) for x in (f"({us} // 3600000000) % 24", f"({us} // 60000000) % 60", f"({us} // 1000000) % 60")
    )
    digits = f"rtrim(lpad(CAST({us} % 1000000 AS VARCHAR), 6, '0'), '0')"
    return f"({day} || 'T' || {clock} || CASE WHEN {us} % 1000000 = 0 THEN '' ELSE '.' || {digits} END)"


#: Events spread over a year (every seventh cut to its second), with the hour a zone of the European Union is ahead in
#: summer: from the last Sunday of March to the last of October, changed at 01:00 UTC.
_SPREAD_SQL = """
WITH e AS (SELECT event_id, ts, epoch_us(ts) AS us, epoch_us(CASE WHEN event_id % 7 = 0 THEN date_trunc('second', ts) ELSE ts END
    + to_days(CAST(event_id % 366 AS INTEGER))) AS s FROM events),
y AS (SELECT *, make_date(year(make_timestamp(s)), 3, 31) AS march, make_date(year(make_timestamp(s)), 10, 31) AS october FROM e),
z AS (SELECT *, epoch_us(CAST(march - CAST(dayofweek(march) AS INTEGER) AS TIMESTAMP)) + 3600000000 AS spring,
    epoch_us(CAST(october - CAST(dayofweek(october) AS INTEGER) AS TIMESTAMP)) + 3600000000 AS autumn FROM y),
"""


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.substring(F.col("ts").cast("string"), 1, 19).cast("timestamp_ntz")
    clock = F.when(F.col("event_id") % 7 == 0, second).otherwise(F.col("ts"))
    days = (F.col("event_id") % 366).cast("int")
    return _events(spark, sf_dir).select("event_id", "ts", F.timestamp_add("DAY", days, clock).alias("spread"))


@register(
    "ts_zone",
    "I01 I02 I03 I12",
    f"""{_SPREAD_SQL}
b AS (SELECT *, CASE WHEN s >= spring AND s < autumn THEN 2 ELSE 1 END AS ahead FROM z),
l AS (SELECT *, s + ahead * 3600000000 AS berlin, s + 19800000000 AS ist FROM b)
SELECT event_id,
  ts + INTERVAL 330 MINUTE AS ts_ist,
  ts - INTERVAL 330 MINUTE AS ts_utc_from_ist,
  make_timestamp(berlin) AS ts_berlin,
  {_iso_sql("ist")} || '+05:30[Asia/Kolkata]' AS ist_text,
  {_iso_sql("ist")} || '+05:30' AS ist_offset_text,
  {_iso_sql("berlin")} || '+0' || ahead || ':00[Europe/Berlin]' AS berlin_text,
  {_iso_sql("berlin")} || '+0' || ahead || ':00' AS berlin_offset_text,
  {_iso_sql("s")} || 'Z[UTC]' AS utc_text
FROM l""",
)
def q_ts_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Asia/Kolkata has kept +05:30 since 1945, so the oracle can add the offset; Berlin changes twice a year.
    return _spread(spark, sf_dir).select(
        "event_id",
        D.utc_to_ist("ts").alias("ts_ist"),
        D.ist_to_utc("ts").alias("ts_utc_from_ist"),
        D.convert_zone("spread", D.UTC, BERLIN).alias("ts_berlin"),
        D.convert_and_format("spread", D.IST).alias("ist_text"),
        D.convert_and_format("spread", NEW_DELHI_OFFSET).alias("ist_offset_text"),
        D.convert_and_format("spread", BERLIN).alias("berlin_text"),
        D.format_with_offset("spread", BERLIN).alias("berlin_offset_text"),
        D.convert_and_format("spread", D.UTC).alias("utc_text"),
    )


@register(
    "ts_month_bounds",
    "I04 I05 I06 I07 I08",
    """SELECT event_id,
  date_trunc('month', ts) AS month_start,
  date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 SECOND AS month_end,
  date_trunc('day', ts) AS day_start,
  CAST(ts AS DATE) AS day,
  CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day_midnight,
  strftime(ts, '%Y-%m') AS year_month,
  strftime(CAST(ts AS DATE) - INTERVAL 1 MONTH, '%Y-%m') AS previous_month
FROM events""",
)
def q_ts_month_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        "event_id",
        D.month_start("ts").alias("month_start"),
        D.month_end("ts").alias("month_end"),
        D.trim_time("ts").alias("day_start"),
        D.to_date("ts").alias("day"),
        D.to_midnight(D.to_date("ts")).alias("day_midnight"),
        D.year_month("ts").alias("year_month"),
        D.previous_year_month("ts").alias("previous_month"),
    )


@register(
    "ts_formats",
    "I09 I10 I11 I13 I14",
    f"""{_SPREAD_SQL}
b AS (SELECT *, CASE WHEN s >= spring + 3600000000 AND s < autumn + 7200000000 THEN 2 ELSE 1 END AS ahead,
    s >= spring + 3600000000 AND s < spring + 7200000000 AS missing FROM z),
l AS (SELECT *, CASE WHEN missing THEN s + 3600000000 ELSE s END AS berlin FROM b)
SELECT event_id,
  strftime(ts, '%Y-%m-%d') AS date_text,
  {_iso_sql("s")} AS datetime_text,
  {_iso_sql("s")} || 'Z' AS instant_text,
  {_iso_sql("s")} || '+05:30' AS offset_text,
  {_iso_sql("berlin")} || '+0' || ahead || ':00[Europe/Berlin]' AS zoned_text,
  substr({_iso_sql("s")}, 12, 8) AS time_text,
  replace(replace(replace(substr({_iso_sql("s")}, 1, 19), '-', ''), ':', ''), 'T', '_') || lpad(CAST((s % 1000000) // 1000 AS VARCHAR), 3, '0') AS compact_text,
  strftime(ts, '%d/%m/%Y %H:%M') AS custom_text,
  CAST(day(ts) AS VARCHAR) || '.' || CAST(month(ts) AS VARCHAR) || '. at ' || CAST(hour(ts) AS VARCHAR) || ' o''clock, '
    || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') AS quoted_text
FROM l""",
)
def q_ts_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The spread clock is read as UTC, as +05:30 and as Berlin time (where one hour of March does not exist).
    return _spread(spark, sf_dir).select(
        "event_id",
        D.format_date(D.to_date("ts")).alias("date_text"),
        D.format_date_time("spread").alias("datetime_text"),
        D.format_utc_offset("spread").alias("instant_text"),
        D.format_offset("spread", NEW_DELHI_OFFSET).alias("offset_text"),
        D.format_zoned("spread", BERLIN).alias("zoned_text"),
        D.format_time("spread").alias("time_text"),
        D.compact_stamp("spread").alias("compact_text"),
        D.format_date_time("ts", "dd/MM/yyyy HH:mm").alias("custom_text"),
        D.format_date_time("ts", "d.M. 'at' H 'o''clock', SSSSSS").alias("quoted_text"),
    )


_TRIM = r"^[\x00-\x20]+|[\x00-\x20]+$"


@register(
    "text_last_segment",
    "I18",
    f"""SELECT page_id, regexp_replace(regexp_replace(url, '{_TRIM}', '', 'g'), '.*/', '') AS last_segment
FROM pages""",
)
def q_text_last_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", X.after_last_slash("url").alias("last_segment"))


@register(
    "text_fold_lines",
    "I23",
    r"SELECT doc_id, regexp_replace(text, ' ?[\t\r\n]+', ' ', 'g') AS folded FROM documents",
)
def q_text_fold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", X.fold_lines("text").alias("folded"))


_TEMPLATE = "doc ${doc_id} (${lang}) from ${source}: ${n_chars} chars, ${missing} kept"


@register(
    "text_template",
    "I19",
    """SELECT doc_id,
  replace(replace(replace(replace('doc ${doc_id} (${lang}) from ${source}: ${n_chars} chars, ${missing} kept',
    '${doc_id}', CAST(doc_id AS VARCHAR)), '${lang}', lang), '${source}', source),
    '${n_chars}', CAST(n_chars AS VARCHAR)) AS filled
FROM documents""",
)
def q_text_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = X.pairs_to_mapping("doc_id", "doc_id", "lang", "lang", "source", "source", "n_chars", "n_chars")
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", X.fill_template(_TEMPLATE, {k: F.col(v) for k, v in values.items()}).alias("filled")
    )


_NESTED_TEMPLATE = "${greeting} ${missing:-nobody} $${doc_id} ${source:-no source}${unknown}"


@register(
    "text_template_nested",
    "I19",
    """SELECT doc_id,
  'doc ' || CAST(doc_id AS VARCHAR) || ' [' || coalesce(lang, 'none') || ']/' || CASE WHEN doc_id % 2 = 0 THEN 'even ${doc_id}' ELSE 'odd ' || CAST(n_chars AS VARCHAR) END
    || ' nobody ${doc_id} ' || coalesce(source, 'no source') || '${unknown}' AS filled
FROM documents""",
)
def q_text_template_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that hold slots, three deep, with defaults and escapes in template and values."""
    even = F.when(F.col("doc_id") % 2 == 0, F.lit("even $${doc_id}")).otherwise(F.lit("odd ${n_chars}"))
    values = {
        "greeting": F.lit("doc ${doc_id} ${place}"),
        "doc_id": F.col("doc_id"),
        "place": F.lit("[${lang:-none}]/${parity}"),
        "parity": even,
        "lang": F.col("lang"),
        "n_chars": F.col("n_chars"),
        "source": F.col("source"),
    }
    return views.table(spark, sf_dir, "documents").select("doc_id", X.fill_template(_NESTED_TEMPLATE, values).alias("filled"))


_WS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}"
    r"\x{2028}\x{2029}\x{205F}\x{3000}"
)


@register(
    "text_wrap",
    "I20 I21 I22",
    f"""SELECT conv_id, turn,
  '(' || regexp_replace(role, '{_TRIM}', '', 'g') || ')' AS wrapped_role,
  CASE WHEN text IS NULL OR regexp_matches(text, '^[{_WS}]*$') THEN ''
       ELSE '> ' || regexp_replace(text, '{_TRIM}', '', 'g') END AS quoted_text,
  replace(role || '-' || CAST(turn AS VARCHAR), '-', '_') AS key
FROM conversations""",
)
def q_text_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = views.table(spark, sf_dir, "conversations")
    return conv.select(
        "conv_id",
        "turn",
        X.bracket_wrap("role").alias("wrapped_role"),
        X.prepend_if_not_blank("text", "> ").alias("quoted_text"),
        X.dash_to_underscore(F.concat(F.col("role"), F.lit("-"), F.col("turn").cast("string"))).alias("key"),
    )


@register(
    "kafka_payload_json",
    "A16 C06",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""",
)
def q_kafka_payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The payload arrives as bytes, as a message value does; the schema goes on the value.
    raw = _events(spark, sf_dir).select("event_id", F.col("props").cast("binary").alias("value"))
    return parse_json_payload(raw, "k INT", keep=["event_id"]).select("event_id", "k")
