"""Log parsing on small inputs: formats, filters, positions in files, cursors."""

from __future__ import annotations

import re
from datetime import datetime

import pytest
from helpers import at
from pyspark.sql import functions as F

from tickloom.functions.timestamps import parse_log_time, spark_pattern
from tickloom.sources import logs

AS_OF = datetime(2025, 11, 1)


def parse(spark, lines, **config):
    config.setdefault("timestamp_format", "%Y-%m-%d %H:%M:%S")
    frame = spark.createDataFrame([(i, text) for i, text in enumerate(lines)], "n long, line string")
    parsed = logs.parse_lines(frame.coalesce(1), logs.LogFormat.parse(config), AS_OF)
    return [
        (r.tag, r.additional_info, r.value, r.us)
        for r in parsed.withColumn("us", F.unix_micros("timestamp")).orderBy("n").collect()
    ]


def us(text):
    return round(at(text).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    ("line", "pattern", "fmt", "moment"),
    [
        ("at=2025-10-27/14:30:25 lvl=error msg=pump stopped", r"at=(\S+) lvl=(\w+) msg=(.*)", "%Y-%m-%d/%H:%M:%S", "2025-10-27T14:30:25"),
        ("<20251027 143025.5> Error: pump stopped", r"<([0-9 .]+)> (\w+): (.*)", "%Y%m%d %H%M%S.%f", "2025-10-27T14:30:25.500000"),
        ("Oct  7 14:30:25 <error> pump stopped", r"([A-Z][a-z]+ +[0-9]+ [0-9:]+) <([a-z]+)> (.+)", "%b %d %H:%M:%S", "2025-10-07T14:30:25"),
        ("27.10.2025;14:30:25.123456;ERROR;pump stopped", r"([^;]+;[^;]+);(\w+);(.+)", "%d.%m.%Y;%H:%M:%S.%f", "2025-10-27T14:30:25.123456"),
    ],
)
def test_layouts(spark, line, pattern, fmt, moment):
    got = parse(spark, [line], log_pattern=pattern, timestamp_format=fmt)
    assert got == [("ERROR", "pump stopped", 1.0, us(moment))]


def test_groups_that_took_no_part_drop_the_line(spark):
    lines = ["2025-01-01 00:00:01 [info] a", "2025-01-01 00:00:02 [] b", "2025-01-01 00:00:03 c", "2025-01-01 00:00:04 [info]"]
    got = parse(spark, lines, log_pattern=r"(\S+ \S+)(?: \[(\w*)\])?(?: (\w+))?")
    assert [g[:2] for g in got] == [("INFO", "a"), ("", "b")]


STAMPS = [
    ("%Y-%m-%d %H:%M:%S,%f", "2025-01-02 03:04:05,123"),
    ("%Y-%m-%d %H:%M:%S,%f", "2025-01-02 03:04:05,1"),
    ("%Y-%m-%d %H:%M:%S,%f", "2025-01-02 03:04:05"),
    ("%Y-%m-%d %H:%M:%S", "2025-1-2 3:4:5"),
    ("%Y-%m-%d %H:%M:%S", "2025-01-02  03:04:05"),
    ("%Y-%m-%d %H:%M:%S", "2025-01-02 03:04:05 x"),
    ("%Y-%m-%d %H:%M:%S", "2025-02-30 03:04:05"),
    ("%Y%m%d %H%M%S", "20250102 030405"),
    ("%d/%b/%Y:%H:%M:%S", "02/Jan/2025:03:04:05"),
    ("%d %B %Y %I:%M %p", "02 January 2025 03:04 PM"),
    ("%Y-%m-%dT%H:%M:%S", "2025-01-02T03:04:05"),
    ("%Y-%m-%dT%H:%M:%S%z", "2025-01-02T03:04:05+02:00"),
    ("%Y-%m-%dT%H:%M:%S%z", "2025-01-02T03:04:05+0200"),
    ("%Y-%j", "2025-032"),
    ("at %H o'clock on %Y-%m-%d", "at 03 o'clock on 2025-01-02"),
    ("100%% %Y-%m-%d", "100% 2025-01-02"),
]


def test_formats_agree_with_strptime(spark):
    for fmt in sorted({f for f, _ in STAMPS}):
        texts = [t for f, t in STAMPS if f == fmt]
        rows = spark.createDataFrame([(t,) for t in texts], "text string")
        parsed = F.unix_micros(parse_log_time(F.col("text"), fmt, F.lit(2025)))
        got = {r.text: r.us for r in rows.select("text", parsed.alias("us")).collect()}
        for text in texts:
            try:
                moment = datetime.strptime(text, fmt)
            except ValueError:
                assert got[text] is None, (fmt, text)
                continue
            moment = moment if moment.tzinfo else at(moment.isoformat())
            assert got[text] == round(moment.timestamp() * 1_000_000), (fmt, text)


def test_unsupported_directive():
    with pytest.raises(ValueError):
        spark_pattern("%U")


PATTERN = r"(\S+ \S+) (\w+) (\S*) ?(.*)"


def test_lines_are_trimmed_filtered_and_dropped(spark):
    lines = [
        "",
        "  \t ",
        "\t2025-01-01 00:00:01 info keep this \t",
        "2025-01-01 00:00:02 info drop that",
        "2025-01-01 00:00:03 info keep not",
        "no time at all, keep",
        "2025-99-01 00:00:04 info keep bad time",
    ]
    got = parse(
        spark, lines, log_pattern=PATTERN, content_group_index=4, include_regex="keep", exclude_regex="not$"
    )
    assert got == [("INFO", "this", 1.0, us("2025-01-01T00:00:01"))]


def test_value_group(spark):
    lines = [f"2025-01-01 00:00:0{i} info {v} text" for i, v in enumerate(["5", "-7", "+8", "x", "2.5", ""])]
    got = parse(spark, lines, log_pattern=PATTERN, content_group_index=4, value_group_index=3)
    assert [g[2] for g in got] == [5.0, -7.0, 8.0]


def test_match_is_anchored_at_the_start_only(spark):
    lines = ["x 2025-01-01 00:00:01 info a", "2025-01-01 00:00:02 info a and more"]
    got = parse(spark, lines, log_pattern=r"none|(\d+-\d+-\d+ \S+) (\w+) (a)")
    assert [g[3] for g in got] == [us("2025-01-01T00:00:02")]


def test_unusual_lines(spark):
    """Non-ASCII text and lines holding the separator are read like all others."""
    lines = [
        "2025-01-01 00:00:01 größe x Übermaß",
        f"2025-01-01 00:00:02 info y a{logs.SEPARATOR}b",
        f"{logs.SEPARATOR}2025-01-01 00:00:03 info y a",
        "2025-01-01 00:00:04 info y $1 \\1",
    ]
    got = parse(spark, lines, log_pattern=r"(\S+ \S+) (\w+) \w (.+)")
    assert [g[:2] for g in got] == [("GRÖSSE", "Übermaß"), ("INFO", f"a{logs.SEPARATOR}b"), ("INFO", "a"), ("INFO", "$1 \\1")]


def test_pattern_translation():
    assert logs.java_regex(r"(?P<a>x)(?P=a)\Z") == r"(?U)(?<a>x)\k<a>\z"
    assert re.match(r"(?P<a>x)(?P=a)\Z", "xx")


def test_config_checks():
    for missing in ("log_pattern", "timestamp_format"):
        config = {"log_pattern": "x", "timestamp_format": "%Y"} | {missing: None}
        with pytest.raises(ValueError, match=missing):
            logs.LogFormat.parse(config)


@pytest.fixture
def log_folder(tmp_path):
    stamp = "2025-01-01 00:{:02d}:{:02d} info line {}"
    body = [stamp.format(i // 60, i % 60, i) for i in range(600)]
    (tmp_path / "a.log").write_text("\n".join(["junk", "2024-01-01 00:00:00 info early", "== start ==", *body]) + "\n")
    (tmp_path / "b.log").write_text("\n".join(["2024-01-01 00:00:00 info only", "no marker"]) + "\n")
    (tmp_path / "c.log").write_text("2025-02-01 00:00:00 info == start ==\n2025-02-01 00:00:01 info after\n")
    return str(tmp_path)


SKIP = {
    "log_pattern": r"(\S+ \S+) (\w+) (.*)",
    "timestamp_format": "%Y-%m-%d %H:%M:%S",
    "skip_until": "== start ==",
}


def test_skip_until_per_file_across_splits(spark, log_folder):
    """Small splits put parts of one file into many tasks."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        frame = logs.read_log_events(spark, log_folder, SKIP, AS_OF)
        assert frame.rdd.getNumPartitions() >= 1
        got = [r.additional_info for r in frame.orderBy("timestamp").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"line {i}" for i in range(600)] + ["== start ==", "after"]


def test_cursor_is_exclusive(spark, log_folder):
    events = logs.read_log_events(spark, log_folder, SKIP, AS_OF, datetime(2025, 2, 1))
    assert [r.additional_info for r in events.collect()] == ["after"]
    assert logs.next_cursor(events).first()[0] is not None
    none = logs.read_log_events(spark, log_folder, SKIP, AS_OF, datetime(2026, 1, 1))
    assert logs.next_cursor(none, datetime(2026, 1, 1)).select(F.unix_micros("last_timestamp")).first()[0] == us(
        "2026-01-01T00:00:00"
    )
