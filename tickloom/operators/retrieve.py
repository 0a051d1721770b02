"""Lookups on the event frame: filters, ordering, latest rows, name lists."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.buckets import days_before
from tickloom.model import Instant, instant, order_key

Tags = str | Sequence[str] | None


def tag_list(tags: Tags) -> list[str]:
    """Tags as a list; None and [] mean no restriction."""
    if tags is None:
        return []
    return [tags] if isinstance(tags, str) else list(tags)


def named(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("name") == F.lit(name))


def with_tags(df: DataFrame, tags: Tags) -> DataFrame:
    """Rows whose tag is listed; rows without a tag never match a list."""
    wanted = tag_list(tags)
    return df.where(F.col("tag").isin(wanted)) if wanted else df


def with_info(df: DataFrame, infos: Tags) -> DataFrame:
    """Rows whose additional_info equals one of the given texts."""
    wanted = tag_list(infos)
    return df.where(F.col("additional_info").isin(wanted)) if wanted else df


def newer_than(df: DataFrame, as_of: datetime, max_age_days: float | None) -> DataFrame:
    """Rows at most `max_age_days` old; no restriction unless positive."""
    if not max_age_days or max_age_days <= 0:
        return df
    return since(df, days_before(as_of, max_age_days))


def since(df: DataFrame, start: Instant) -> DataFrame:
    """Rows from a moment on. On a frame of the event table that still has its
    `period` the folders of earlier periods are not opened (a period is a day or
    a month, named by its first day)."""
    df = df.where(F.col("timestamp") >= instant(start))
    if "period" in df.columns:
        df = df.where(F.col("period") >= F.date_trunc("month", instant(start)).cast("date"))
    return df


def within(start: Instant | None, end: Instant | None) -> Column:
    """Whether a row lies in the half-open range [start, end)."""
    holds = F.lit(True)
    if start is not None:
        holds = holds & (F.col("timestamp") >= instant(start))
    if end is not None:
        holds = holds & (F.col("timestamp") < instant(end))
    return F.coalesce(holds, F.lit(False))


def between(df: DataFrame, start: Instant | None, end: Instant | None) -> DataFrame:
    """Rows in the half-open range [start, end)."""
    if start is not None:
        df = since(df, start)
    if end is not None:
        df = df.where(F.col("timestamp") < instant(end))
        if "period" in df.columns:
            df = df.where(F.col("period") <= F.to_date(instant(end)))
    return df


def chronological(df: DataFrame) -> DataFrame:
    return df.orderBy("timestamp", "event_id")


def newest(df: DataFrame, n: int) -> DataFrame:
    """The n newest rows. Every task keeps its own top n, so nothing large is sorted."""
    return df.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(n)


def latest(df: DataFrame, n: int) -> DataFrame:
    """The n newest rows, oldest of them first."""
    return chronological(newest(df, n))


def get_events(
    df: DataFrame,
    name: str,
    tags: Tags = None,
    max_age_days: float | None = 0,
    max_results: int | None = 0,
    as_of: datetime | None = None,
) -> DataFrame:
    """Events of one name by tag and age, chronological, optionally the latest n."""
    rows = with_tags(named(df, name), tags)
    if max_age_days and max_age_days > 0:
        if as_of is None:
            raise ValueError("max_age_days needs as_of")
        rows = newer_than(rows, as_of, max_age_days)
    return latest(rows, max_results) if max_results and max_results > 0 else chronological(rows)


def latest_by_tag(df: DataFrame, name: str, tags: Tags = None, ties: str = "all") -> DataFrame:
    """The newest event of every tag, in tag order.

    With `ties="all"` every event at a tag's newest moment is kept: a hash
    aggregate finds the moments and a join fetches their events, so a tag or
    moment shared by a third of the rows is still spread over tasks. With "one"
    the highest event_id decides, and one aggregate carries the whole event.
    """
    if ties not in ("all", "one"):
        raise ValueError(f"unknown ties {ties!r}")
    rows = with_tags(named(df, name), tags).where(F.col("tag").isNotNull())
    if ties == "one":
        newest_event = F.max_by(F.struct(*df.columns), order_key()).alias("_event")
        found = rows.groupBy("tag").agg(newest_event).select("_event.*")
    else:
        ends = rows.groupBy("tag").agg(F.max("timestamp").alias("timestamp"))
        found = rows.join(ends, ["tag", "timestamp"]).select(df.columns)
    return found.orderBy("tag", "timestamp", "event_id")


def event_names(df: DataFrame) -> DataFrame:
    return df.select("name").distinct().orderBy("name")


def event_name_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("name").agg(F.count(F.lit(1)).alias("count")).orderBy("name")


def raw_event_page(df: DataFrame, name: str, limit: int) -> DataFrame:
    """The latest `limit` rows of one name with their 1-based row number.

    The numbering window runs over that page alone.
    """
    page = get_events(df, name, max_results=limit)
    return page.withColumn("row_index", F.row_number().over(Window.orderBy("timestamp", "event_id")))
