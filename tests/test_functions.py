"""Column helpers: zones, months, formats, durations, text."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.functions import datetime as D
from tidewater.functions import duration as U
from tidewater.functions import text as X


def test_zone_conversion_and_bounds(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 10, 20, 0),), (None,)], "ts TIMESTAMP_NTZ")
    r = df.select(
        D.utc_to_ist("ts").alias("ist"),
        D.ist_to_utc("ts").alias("utc"),
        D.month_start("ts").alias("ms"),
        D.month_end("ts").alias("me"),
        D.trim_time("ts").alias("day"),
        D.previous_year_month("ts").alias("prev"),
        D.compact_stamp("ts").alias("c"),
        D.format_time("ts").alias("t"),
    ).collect()
    a = r[0]
    assert a.ist == dt.datetime(2024, 2, 11, 1, 30)
    assert a.utc == dt.datetime(2024, 2, 10, 14, 30)
    assert a.ms == dt.datetime(2024, 2, 1) and a.me == dt.datetime(2024, 2, 29, 23, 59, 59)
    assert a.day == dt.datetime(2024, 2, 10) and a.prev == "2024-01"
    assert a.c == "20240210_200000000" and a.t == "20:00:00"
    assert all(v is None for v in r[1])


def test_month_range():
    assert D.month_range("2024-12") == (dt.datetime(2024, 12, 1), dt.datetime(2025, 1, 1))
    with pytest.raises(ValueError):
        D.month_range("2024-1")


def test_duration_parts_and_text(spark):
    df = spark.createDataFrame([(0,), (5000,), (12863113,), (None,)], "ms BIGINT")
    parts = U.duration_parts("ms")
    rows = df.select(
        U.duration_text("ms").alias("t"),
        U.compose_ms(parts["hours"], parts["minutes"], parts["seconds"], parts["millis"]).alias("back"),
    ).collect()
    assert [r.t for r in rows] == ["", "5 Seconds ", "3 Hours 34 Minutes 23 Seconds 113 Milli Seconds", None]
    assert [r.back for r in rows[:3]] == [0, 5000, 12863113]


def test_negative_duration_is_an_error(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1))], "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    with pytest.raises(Exception):
        df.select(U.duration_ms("a", "b")).collect()


def test_text_helpers(spark):
    df = spark.createDataFrame(
        [("  http://h/a/b/page  ", " x ", "line1\n\tline2 \r\nend"), ("\t", "", None)],
        "url STRING, v STRING, t STRING",
    )
    r = df.select(
        X.after_last_slash("url").alias("last"),
        X.bracket_wrap("v").alias("w"),
        X.prepend_if_not_blank("v", "> ").alias("p"),
        X.fold_lines("t").alias("f"),
    ).collect()
    assert (r[0].last, r[0].w, r[0].p, r[0].f) == ("page", "(x)", "> x", "line1 line2 end")
    assert (r[1].last, r[1].w, r[1].p, r[1].f) == ("", "()", "", None)


def test_template_and_pairs(spark):
    df = spark.createDataFrame([("a", None)], "x STRING, y STRING")
    out = df.select(X.fill_template("${x}-${y}-${z}", {"x": F.col("x"), "y": F.col("y")}).alias("o")).first().o
    assert out == "a-${y}-${z}"
    esc = df.select(X.fill_template("$${x}=${x}", {"x": F.col("x")}).alias("o")).first().o
    assert esc == "${x}=a"
    assert X.pairs_to_mapping("a", "1", "b", "2") == {"a": "1", "b": "2"}
    with pytest.raises(ValueError):
        X.pairs_to_mapping("a")


def test_problem_reason(spark):
    df = spark.createDataFrame([("c", "t", "m", None, ["1", "2"]), ("c", "t", "m", "x", []), ("c", "t", "m", None, ["a", None])],
                               "code STRING, title STRING, message STRING, cause STRING, args ARRAY<STRING>")
    out = [r.o for r in df.select(X.problem_reason("code", "title", "message", "cause", "args").alias("o")).collect()]
    assert out == [
        "code: c, title: t, message: m, cause: , args: {1,2}",
        "code: c, title: t, message: m, cause: x, args: ",
        "code: c, title: t, message: m, cause: , args: {a,<null>}",
    ]


def test_offset_formatting(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 2, 10, 20, 0),), (dt.datetime(2024, 7, 1, 12, 0),)], "ts TIMESTAMP_NTZ"
    )
    out = df.select(
        D.format_with_offset("ts", D.IST).alias("ist"),
        D.format_with_offset("ts", "America/New_York").alias("ny"),
        D.format_with_offset("ts", D.UTC).alias("utc"),
    ).collect()
    assert out[0].ist == "2024-02-11T01:30:00+05:30"
    assert out[0].ny == "2024-02-10T15:00:00-05:00" and out[1].ny == "2024-07-01T08:00:00-04:00"
    assert out[0].utc == "2024-02-10T20:00:00Z"


def iso(value: dt.datetime) -> str:
    """ISO text as a JVM date-time of the value prints it."""
    text = value.replace(microsecond=0, tzinfo=None).isoformat()
    return text + (f".{value.microsecond:06d}".rstrip("0") if value.microsecond else "")


def offset_of(value: dt.datetime) -> str:
    seconds = int(value.utcoffset().total_seconds())
    size = abs(seconds)
    text = f"{'-' if seconds < 0 else '+'}{size // 3600:02d}:{size // 60 % 60:02d}" + (f":{size % 60:02d}" if size % 60 else "")
    return text if seconds else "Z"


CLOCKS = [
    dt.datetime(2024, 3, 10, 2, 30, 0, 123456),  # missing in New York
    dt.datetime(2024, 3, 31, 2, 15, 0, 500000),  # missing in Berlin
    dt.datetime(2024, 10, 27, 2, 15),  # twice in Berlin
    dt.datetime(2024, 11, 3, 1, 30, 0, 1),  # twice in New York
    dt.datetime(2024, 7, 1, 12, 0, 59, 999999),
    dt.datetime(1890, 1, 1, 0, 0, 0, 120),  # local mean time, odd seconds
    dt.datetime(1, 2, 3, 4, 5, 6, 7),
    dt.datetime(2024, 2, 29, 23, 59, 59),
]


@pytest.fixture(params=["UTC", "America/New_York", "Europe/Berlin"])
def session_zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def clocks(spark):
    rows = [(i, v.strftime("%Y-%m-%d %H:%M:%S.%f") if v.year > 999 else f"{v.year:04d}" + v.strftime("-%m-%d %H:%M:%S.%f")) for i, v in enumerate(CLOCKS)]
    return spark.createDataFrame([*rows, (99, None)], "i INT, t STRING").select("i", F.col("t").cast("timestamp_ntz").alias("ts"))


def test_wall_clocks_are_rendered_without_the_session_zone(spark, session_zone):
    pattern = "yyyy/MM/dd 'T''s' HH.mm:ss SSS|SSSSSSSSS|yy d M H m s"
    got = clocks(spark).select(
        "i", D.iso_local("ts"), D.format_time("ts"), D.compact_stamp("ts"), D.format_date("ts"), D.render("ts", pattern),
        D.month_start("ts").cast("string"), D.month_end("ts").cast("string"), D.trim_time("ts").cast("string"), D.format_utc_offset("ts"),
    ).collect()
    for row in got:
        if row.i == 99:
            assert all(v is None for v in row[1:])
            continue
        v = CLOCKS[row.i]
        y, micro = f"{v.year:04d}", f"{v.microsecond:06d}"
        day, clock = f"{y}-{v.month:02d}-{v.day:02d}", f"{v.hour:02d}:{v.minute:02d}:{v.second:02d}"
        last = (dt.date(v.year + v.month // 12, v.month % 12 + 1, 1) - dt.timedelta(days=1)).day
        assert list(row[1:]) == [
            iso(v), clock, f"{day.replace('-', '')}_{clock.replace(':', '')}{micro[:3]}", day,
            f"{day.replace('-', '/')} T's {clock.replace(':', '.', 1)} {micro[:3]}|{micro}000|{y[2:]} {v.day} {v.month} {v.hour} {v.minute} {v.second}",
            f"{y}-{v.month:02d}-01 00:00:00", f"{y}-{v.month:02d}-{last} 23:59:59", f"{day} 00:00:00", iso(v) + "Z",
        ]


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Asia/Kolkata", "UTC", "Asia/Kathmandu"])
def test_instants_and_zoned_clocks_show_offset_and_zone(spark, session_zone, zone):
    from zoneinfo import ZoneInfo

    z = ZoneInfo(zone)
    got = clocks(spark).filter("i <> 6").select("i", D.convert_and_format("ts", zone), D.format_with_offset("ts", zone), D.format_zoned("ts", zone)).collect()
    for row in got:
        if row.i == 99:
            assert all(v is None for v in row[1:])
            continue
        there = CLOCKS[row.i].replace(tzinfo=dt.timezone.utc).astimezone(z)
        assert row[1] == f"{iso(there)}{offset_of(there)}[{zone}]"
        assert row[2] == f"{iso(there)}{offset_of(there)}"
        # Through UTC a missing clock lands behind the gap; one that occurs twice takes its first occurrence.
        own = CLOCKS[row.i].replace(tzinfo=z).astimezone(dt.timezone.utc).astimezone(z)
        assert row[3] == f"{iso(own)}{offset_of(own)}[{zone}]"


def test_fixed_offsets_have_no_zone_id(spark):
    got = clocks(spark).filter("i = 4").select(
        D.format_offset("ts", "+05:30"), D.format_offset("ts", "Z"), D.convert_and_format("ts", "-04:00"), D.format_offset("ts", "+05:30", "HH:mm"),
        D.format_zoned("ts", "Asia/Kolkata", "HH:mm"), D.convert_and_format("ts", "Asia/Kolkata", "HH:mm"),
    ).first()
    assert list(got) == [
        "2024-07-01T12:00:59.999999+05:30", "2024-07-01T12:00:59.999999Z", "2024-07-01T08:00:59.999999-04:00", "12:00", "12:00", "17:30",
    ]
    with pytest.raises(ValueError):
        D.format_offset("ts", "Asia/Kolkata")
    with pytest.raises(ValueError):
        D.render(F.lit(None), "yyyy 'open")


def test_renderers_follow_their_templates(spark):
    from tidewater.functions.logs import LOG_TEMPLATE, render_log_line

    df = spark.createDataFrame(
        [("2024-01-01T00:00:00.000Z", "ERROR", 7, "App1", "main", "a.B", "boom: x", "c", "t", "m", None, ["1", "2"])],
        "ts STRING, level STRING, pid INT, app STRING, thread STRING, cls STRING, msg STRING, "
        "code STRING, title STRING, message STRING, cause STRING, args ARRAY<STRING>",
    )
    row = df.select(
        render_log_line(F.col("ts"), F.col("level"), F.col("pid"), F.col("app"), F.col("thread"), F.col("cls"), F.col("msg")).alias("a"),
        X.fill_template(LOG_TEMPLATE, {
            "timestamp": F.col("ts"), "level": F.col("level"), "pid": F.col("pid"), "application": F.col("app"),
            "thread": F.col("thread"), "class": F.col("cls"), "message": F.col("msg"),
        }).alias("b"),
        X.problem_reason("code", "title", "message", "cause", "args").alias("c"),
        X.fill_template(X.REASON_TEMPLATE, {
            "code": F.col("code"), "title": F.col("title"), "message": F.col("message"),
            "cause": F.coalesce(F.col("cause"), F.lit("")), "args": X.array_text(F.col("args")),
        }).alias("d"),
    ).first()
    assert row.a == row.b
    assert row.c == row.d


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_now_in_zone_matches_python(spark, session_zone):
    from zoneinfo import ZoneInfo

    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        row = spark.range(1).select(
            D.now_in_zone(D.IST).alias("now"), D.today_in_zone(D.IST).alias("today"), D.current_month_in_zone().alias("m")
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
    py_now = dt.datetime.now(ZoneInfo(D.IST)).replace(tzinfo=None)
    assert abs((row.now - py_now).total_seconds()) < 120
    assert row.today == row.now.date() and row.m == row.now.strftime("%Y-%m")
    assert row.m == D.current_year_month(D.IST, row.today)


def plain_fill(text: str, values: dict, path: tuple = ()) -> str:
    """Substitution by recursion, as stated: values are expanded, escapes come out, circles are errors."""
    import re

    def one(m):
        if m.group(0) == "$${":
            return "${"
        name, mark, default = m.group(1).partition(":-")
        value = values.get(name)
        if value is None:
            return default if mark else m.group(0)
        if name in path:
            raise ValueError("circle")
        return plain_fill(value, values, (*path, name))

    return re.sub(r"\$\$\{|\$\{([^}]*)\}", one, text)


TEMPLATES = ["${a}|${b}|${n:-none}|${n}|${zz:-d}|${zz}|$${a}|$ {a}|$${", "", "${}", "no slots", "${a:-x}${c}", "${a${b}}", "x${"]


@pytest.mark.parametrize("stored", [False, True])
def test_values_that_hold_slots_are_expanded(spark, stored):
    rows = [
        {"a": "1", "b": "2", "c": "3", "n": None},
        {"a": "<${b}>", "b": "(${c})", "c": "end", "n": None},  # a chain
        {"a": "${c}${c}", "b": "${c:-x} ${n:-y} ${n}", "c": "$${a} $${", "n": None},  # a diamond, defaults and escapes in values
        {"a": "${q:-dflt}", "b": "${n}", "c": "", "n": "${c}"},
        {"a": None, "b": "${a}", "c": "${b}", "n": "${a:-none}"},
    ]
    df = spark.createDataFrame(rows, "a STRING, b STRING, c STRING, n STRING")
    for template in TEMPLATES:
        for order in (["a", "b", "c", "n"], ["n", "c", "b", "a"]):  # the order of names does not matter
            slots = {k: F.col(k) for k in order}
            text = F.when(F.lit(True) | F.col("c").isNull(), F.lit(template)) if stored else template
            got = df.select("a", "b", "c", "n", X.fill_template(text, slots).alias("o")).collect()
            assert [r.o for r in got] == [plain_fill(template, {k: r[k] for k in "abcn"}) for r in got], template


def test_values_in_a_circle_are_an_error(spark):
    df = spark.createDataFrame([("${b}", "${c}", "${a}", "x"), ("${b}", "${c}", "${c}", "x")], "a STRING, b STRING, c STRING, d STRING")
    fill = lambda t: X.fill_template(t, {k: F.col(k) for k in "abcd"})
    for template in ("${a}", F.concat(F.lit("${"), F.lit("b}"))):
        with pytest.raises(Exception, match="circle"):
            df.select(fill(template)).collect()
    # A circle that the template does not reach is none of its business; one that is its own value is.
    assert [r[0] for r in df.select(fill("${d}")).collect()] == ["x", "x"]
    with pytest.raises(Exception, match="circle: c"):
        df.filter(F.col("c") == "${c}").select(fill("${a}")).collect()


def test_positional_values_are_inserted_as_they_are(spark):
    df = spark.createDataFrame([("{1}", "Q")], "x STRING, y STRING")
    assert df.select(X.fill_positional(F.lit("{0} {1}"), [F.col("x"), F.col("y")])).first()[0] == "{1} Q"

