"""Log lines -> events."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.functions.timestamps import parse_log_time, strip
from tickloom.model import EVENT_COLUMNS, EVENT_SCHEMA, Instant, instant

DEFAULT_EVENT_NAME = "log_message"  # fixed value
SEPARATOR = "\x1f"
_ALL = 2**31 - 1


@dataclass(frozen=True)
class LogFormat:
    """How one kind of log is read. Group numbers count from 1."""

    log_pattern: str
    timestamp_format: str
    timestamp_group_index: int = 1
    severity_group_index: int = 2
    content_group_index: int = 3
    value_group_index: int | None = None
    include_regex: str | None = None
    exclude_regex: str | None = None
    skip_until: str | None = None
    event_name: str = DEFAULT_EVENT_NAME

    @classmethod
    def parse(cls, config: Mapping[str, Any]) -> LogFormat:
        for required in ("log_pattern", "timestamp_format"):
            if not config.get(required):
                raise ValueError(f"{required} not specified in collector configuration")
        return cls(**{k: config[k] for k in cls.__dataclass_fields__ if config.get(k) is not None})


def java_regex(pattern: str, unicode: bool = True) -> str:
    """A Python pattern as Java reads it: named groups and Unicode classes."""
    pattern = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)
    return ("(?U)" if unicode else "") + pattern.replace(r"\Z", r"\z")


def search(text: Column, pattern: str) -> Column:
    return text.rlike(java_regex(pattern))


def trimmed_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines without surrounding blanks; blank lines are dropped.

    Exploding the one trimmed line keeps this and later filters above the trim;
    pushed below it, each of them would trim every line again.
    """
    others = [c for c in lines.columns if c != column]
    return lines.select(*others, F.explode(F.array(strip(F.col(column)))).alias(column)).where(F.length(column) > 0)


def skip_until(lines: DataFrame, pattern: str) -> DataFrame:
    """Drop the lines of each file before its first match; the match stays.

    Needs `file` and `pos`. Files without a match give nothing. The first match
    is a small aggregate per file; the join back lets adaptive execution
    broadcast it, or split the lines of one huge file over several tasks.
    """
    first = lines.where(search(F.col("line"), pattern)).groupBy("file").agg(F.min("pos").alias("_first"))
    return lines.join(first, "file").where(F.col("pos") >= F.col("_first")).drop("_first")


def first_matches(lines: DataFrame, pattern: str, started: DataFrame) -> DataFrame:
    """One row per file of an increment: `_first`, its first match here, and
    `_seen`, whether it had one in an earlier increment.

    `was` is the name a file had then, null if it is new, so a file that took the
    name of another waits for its own match, and a renamed one goes on.
    """
    hit = F.min(F.when(search(F.col("line"), pattern), F.col("pos"))).alias("_first")
    here = lines.groupBy("file", "was").agg(hit)
    known = started.select(F.col("file").alias("was"), F.lit(True).alias("_seen")).distinct()
    return here.join(known, "was", "left").select("file", "_first", F.coalesce("_seen", F.lit(False)).alias("_seen"))


def after_matches(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """Lines of files that had their match before, and from the first match of the others on."""
    joined = lines.join(matches, "file")
    return joined.where(F.col("_seen") | (F.col("pos") >= F.col("_first"))).drop("_first", "_seen")


def with_groups(lines: DataFrame, pattern: str, indexes: Sequence[int]) -> DataFrame:
    """Add `_groups`: the wanted groups of an anchored match, NULL without a match.

    One replacement yields all groups: a matching line becomes them, each after
    a separator, while other lines stay as they are. Lines that hold the
    separator themselves take one extraction per group. On ASCII lines the much
    faster ASCII classes mean the same. A group that took no part in the match
    is empty text here; `took_part` tells it from one that matched empty text.
    """
    line = F.col("line")
    out = "".join(f"{SEPARATOR}${i}" for i in indexes)
    ascii_regex, full_regex = java_regex(pattern, False), java_regex(pattern)

    def replaced(regex: str) -> Column:
        return F.regexp_replace(line, f"^(?:{regex})(?s:.*)$", out)

    clear = ~F.contains(line, F.lit(SEPARATOR))
    is_ascii = F.octet_length(line) == F.length(line)
    matched = F.when(clear & is_ascii, replaced(ascii_regex)).when(clear, replaced(full_regex))
    apart = F.array(*[F.regexp_extract(line, f"^(?:{full_regex})", i) for i in indexes])
    groups = (
        F.when(F.col("_matched").isNull(), F.when(line.rlike(f"^(?:{full_regex})"), apart))
        .when(F.startswith("_matched", F.lit(SEPARATOR)), F.split(F.substring("_matched", 2, _ALL), SEPARATOR))
    )
    return lines.withColumn("_matched", matched).select(*lines.columns, groups.alias("_groups"))


def took_part(line: Column, pattern: str, group: Column, index: int) -> Column:
    """Whether a group of an anchored match matched anything, were it only empty text.

    Only asked where the group is empty: a reference to it behind the match then
    holds unless the group took no part.
    """
    return (group != "") | line.rlike(f"^(?>{java_regex(pattern)})\\{index}")


def parse_lines(lines: DataFrame, fmt: LogFormat, as_of: Instant) -> DataFrame:
    """Add name, value, tag, additional_info and timestamp.

    Lines that cannot be parsed are dropped, as are those whose severity or
    content group took no part in the match.
    """
    lines = trimmed_lines(lines)
    if fmt.skip_until:
        lines = skip_until(lines, fmt.skip_until)
    if fmt.include_regex:
        lines = lines.where(search(F.col("line"), fmt.include_regex))
    if fmt.exclude_regex:
        lines = lines.where(~search(F.col("line"), fmt.exclude_regex))
    wanted = [fmt.timestamp_group_index, fmt.severity_group_index, fmt.content_group_index]
    if fmt.value_group_index:
        wanted.append(fmt.value_group_index)
    grouped = with_groups(lines, fmt.log_pattern, wanted)

    def group(place: int) -> Column:
        return F.element_at("_groups", place + 1)

    if fmt.value_group_index:
        digits = strip(group(3))
        value = F.when(digits.rlike(r"^[+-]?\d+$"), digits.try_cast("bigint"))
    else:
        value = F.lit(1).cast("long")
    # A filter on the parsed columns would be pushed below them and parse every
    # line twice; emitting zero or one rows per line keeps it above.
    event = F.struct(
        F.lit(fmt.event_name).alias("name"),
        value.cast("double").alias("value"),
        F.upper(group(1)).alias("tag"),
        strip(group(2)).alias("additional_info"),
        parse_log_time(group(0), fmt.timestamp_format, F.year(instant(as_of))).alias("timestamp"),
    )
    whole = F.col("_groups").isNotNull()
    for place in (1, 2):
        whole = whole & took_part(F.col("line"), fmt.log_pattern, group(place), wanted[place])
    parsed = grouped.select(*lines.columns, F.inline(F.when(whole, F.array(event))))
    return parsed.where(F.col("timestamp").isNotNull() & F.col("value").isNotNull())


def after_cursor(events: DataFrame, cursor: datetime | None) -> DataFrame:
    """Events strictly newer than the cursor; no cursor means all of them."""
    return events if cursor is None else events.where(F.col("timestamp") > instant(cursor))


def next_cursor(events: DataFrame, cursor: datetime | None = None) -> DataFrame:
    """One row: the newest moment seen so far."""
    newest = F.max("timestamp")
    if cursor is not None:
        newest = F.greatest(newest, instant(cursor))
    return events.agg(newest.alias("last_timestamp"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and position in it.

    Within a file, blocks are ordered by offset and lines by reading order.
    Both columns are fixed right at the scan, before any shuffle.
    """
    raw = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    return raw.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), place.alias("pos"))


def as_events(parsed: DataFrame, event_id: Column | None = None) -> DataFrame:
    """Parsed lines as an event frame; ids follow the reading order."""
    key = event_id if event_id is not None else F.col("pos.nth")
    frame = parsed.withColumn("event_id", key)
    return frame.select(*[F.col(c).cast(EVENT_SCHEMA[c].dataType).alias(c) for c in EVENT_COLUMNS])


def read_log_events(
    spark: SparkSession, path: str, config: Mapping[str, Any] | LogFormat, as_of: Instant, cursor: datetime | None = None
) -> DataFrame:
    """Events of a log folder that are newer than the cursor.

    Every file is read whole, whenever it was changed; `tail` reads only what was
    added to files since the last time.
    """
    fmt = config if isinstance(config, LogFormat) else LogFormat.parse(config)
    return after_cursor(as_events(parse_lines(read_log_lines(spark, path), fmt, as_of)), cursor)
