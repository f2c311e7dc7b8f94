"""Error-line extraction edge cases and the render/parse round trip."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tests.plan_utils import explain_text
from tidewater.functions.logs import ERROR_LINE_PATTERN, parse_error_lines, render_log_line
from tidewater.plans import views
from tidewater.plans.error_logs import extract_errors

GOOD = "2024-11-01T10:00:00.000+05:30 ERROR 86228 --- [AppOne] [  restartedMain] a.b.C     : boom at x. Cause y"


def _parse(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "log_line STRING")
    return [tuple(r) for r in parse_error_lines(df).collect()]


def test_good_line(spark):
    assert _parse(spark, [GOOD]) == [("2024-11-01T10:00:00.000+05:30", "AppOne", ": boom at x. Cause y")]


def test_message_starts_at_last_colon(spark):
    line = GOOD.replace("boom at x. Cause y", "first: second")
    assert _parse(spark, [line])[0][2] == ": second"


def test_rejected_lines(spark):
    rejected = [
        " " + GOOD,  # leading blank
        "x " + GOOD,  # text before the stamp... still a stamp-like token? no 'T' rule
        GOOD.replace("AppOne", "App_One"),  # underscore not allowed
        GOOD.replace(" ERROR ", " INFO "),
        "2024-11-01T10:00:00Z ERROR 1 --- [AppOne] [  t] c     no colon here",
        None,
    ]
    out = _parse(spark, rejected)
    # "x <stamp>": the first token has no 'T', so the stamp group cannot start at 0.
    assert out == []


def test_second_line_is_cut(spark):
    line = GOOD + "\n\tat some.Frame: line 2"
    out = _parse(spark, [line])
    assert out == [("2024-11-01T10:00:00.000+05:30", "AppOne", ": boom at x. Cause y")]


def test_hyphen_and_digits_in_application(spark):
    out = _parse(spark, [GOOD.replace("AppOne", "app-2")])
    assert out[0][1] == "app-2"


def test_render_parse_round_trip(spark):
    sf = "/root/testdata/sf0.001"
    events = views.table(spark, sf, "events")
    errors = extract_errors(views.log_lines(spark, sf))
    assert errors.count() == events.where(F.col("event_type") == "error").count()
    # every parsed stamp is an error event's stamp
    stamps = events.where(F.col("event_type") == "error").select(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")).alias("datetime")
    )
    assert errors.select("datetime").exceptAll(stamps).count() == 0


def test_payload_bytes(spark):
    raw = spark.createDataFrame([(bytearray(GOOD, "utf-8"),)], "value BINARY")
    assert extract_errors(raw, payload_column="value").count() == 1


def test_render_fields(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "ts TIMESTAMP_NTZ")
    line = df.select(
        render_log_line(
            F.lit("S"), F.lit("ERROR"), F.lit(1), F.lit("A"), F.lit("t"), F.lit("c"), F.lit("m")
        ).alias("l")
    ).first().l
    assert line == "S ERROR 1 --- [A] [  t] c     : m"


def _by_extract(spark, lines):
    """The same groups by test and extraction, one run of the pattern each."""
    df = spark.createDataFrame([(x,) for x in lines], "log_line STRING")
    line = F.col("log_line")
    rows = df.filter(line.rlike(ERROR_LINE_PATTERN)).select(*[F.regexp_extract(line, ERROR_LINE_PATTERN, g) for g in (1, 3, 4)])
    return [tuple(r) for r in rows.collect()]


def test_one_run_of_the_pattern_equals_test_and_extraction(spark):
    lines = [
        GOOD, "", None, "ERROR", GOOD + "\nsecond line: x", GOOD + "\r\n", "\n" + GOOD, GOOD.replace("boom", "$1 \\\\ $9"),
        GOOD.replace("boom", "a\u0000b\u0001c\u0002d\u0003"), "\u0000" + GOOD, GOOD.replace("AppOne", "App\u0000One"),
        GOOD.replace("restartedMain", "x\u0000\u0000y"), GOOD.replace("2024", "20\u000024"), "\u0000\u0000\u0000", "\u0000aT\u0000b ERROR 1 --- [x] : y",
        GOOD.replace(" ERROR ", "\t ERROR\t"), GOOD.replace("ERROR", "INFO ERROR"), GOOD + ":", "é" + GOOD, GOOD.replace("x.", "\u2028x:"),
    ]
    assert _parse(spark, lines) == _by_extract(spark, lines)
    assert len(_by_extract(spark, lines)) > 8


def test_a_line_runs_through_the_pattern_once(spark):
    df = spark.createDataFrame([(GOOD,)], "log_line STRING")
    plan = explain_text(parse_error_lines(df), "simple")
    assert plan.count("regexp_replace(") == 1 and "regexp_extract" not in plan and "RLIKE" not in plan.upper()


def test_an_own_pattern_may_match_anywhere(spark):
    df = spark.createDataFrame([("x 2024T1 z [app] !:boom",)], "log_line STRING")
    rows = parse_error_lines(df, pattern=r"(\d+T\d)( z) \[(\w+)\] !(:.*)").collect()
    assert [tuple(r) for r in rows] == [("2024T1", "app", ":boom")]
