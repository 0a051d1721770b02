"""Hourly partials of events, and what widgets can be answered from them.

A partial is one row per hour, name and tag with the numbers that every scalar
aggregate and every interval from an hour on follows from: counts, sum, lowest
and highest value, and the first and last value with the keys that order them.
Partials of partials are partials, so they may be kept per write and added up
when they are read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.aggregates import SCALAR_KINDS
from tickloom.functions.buckets import CALENDAR_INTERVALS, bucket, days_before
from tickloom.functions.numbers import round_half_up, steady_round
from tickloom.model import instant, order_key
from tickloom.operators import retrieve
from tickloom.plans.specs import SourceSpec, WidgetSpec

INTERVALS = ("hour", *CALENDAR_INTERVALS)
WIDGETS = ("counter", "gauge", "pie_chart", "line_graph", "bar_graph")
PARTIAL_DDL = (
    "hour timestamp, tag string, n long, n_values long, total double, low double, high double, "
    "first_key decimal(38,0), first_value double, last_key decimal(38,0), last_value double, first_at timestamp, last_at timestamp"
)
PARTIALS = [part.split()[0] for part in PARTIAL_DDL.split(", ")]


def partials(events: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Partials of events, per `keys`, tag and hour, in one hash aggregate with a map-side part."""
    key = order_key()
    rows = events.groupBy(*keys, "tag", bucket("timestamp", "hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("n_values"),
        F.sum("value").alias("total"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.min(key).alias("first_key"),
        F.min_by("value", key).alias("first_value"),
        F.max(key).alias("last_key"),
        F.max_by("value", key).alias("last_value"),
        F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"),
    )
    return rows.select(*keys, *PARTIALS)


def merged(kind: str) -> Column:
    """The aggregate of `functions.aggregates` from partials."""
    mean = F.sum("total") / F.sum("n_values")
    values = {
        "last": F.max_by("last_value", "last_key"),
        "first": F.min_by("first_value", "first_key"),
        "average": steady_round(mean, 4),
        "average_round": round_half_up(F.round(mean, 9)),
        "sum": F.sum("total"),
        "max": F.max("high"),
        "min": F.min("low"),
        "count": F.sum("n"),
        "first_datetime": F.min("first_at"),
        "last_datetime": F.max("last_at"),
        "diff_last_first": F.max_by("last_value", "last_key") - F.min_by("first_value", "first_key"),
        "diff_max_min": F.max("high") - F.min("low"),
    }
    if kind not in values:
        raise ValueError(f"unknown aggregate {kind!r}, expected one of {SCALAR_KINDS}")
    return values[kind]


def interval_values(rows: DataFrame, interval: str, function: str, keys: tuple[str, ...] = ("series_idx", "name")) -> DataFrame:
    """What `interval_aggregate` gives, from partials."""
    if interval not in INTERVALS:
        raise ValueError(f"partials are hourly, interval {interval!r} is shorter")
    return rows.groupBy(*keys, bucket("hour", interval).alias("timestamp")).agg(
        merged(function).cast("double").alias("value"), F.sum("n").alias("n")
    )


def source_partials(kept: DataFrame, events: DataFrame, source: SourceSpec, name: str, as_of: datetime) -> DataFrame:
    """Partials of the events of a source.

    An age limit seldom falls on a full hour: events of the hour it cuts are read
    and summed up themselves, the hours behind it are taken from what is kept.
    """
    rows = retrieve.with_tags(retrieve.named(kept, name), source.tags).select("name", *PARTIALS)
    if source.max_age_days and source.max_age_days > 0:
        cutoff = instant(days_before(as_of, source.max_age_days))
        full = F.date_trunc("hour", cutoff)
        rows = rows.where((F.col("hour") > full) | ((F.col("hour") == full) & (full == cutoff)))
        cut = retrieve.with_tags(retrieve.named(events, name), source.tags)
        cut = retrieve.between(cut, cutoff, F.when(full != cutoff, full + F.expr("INTERVAL 1 HOUR")).otherwise(cutoff))
        rows = rows.unionByName(partials(cut))
    return rows


def answers(widget: WidgetSpec, sources: dict[str, SourceSpec], interval: str, ranged: bool) -> bool:
    """Whether the partials hold all that a widget asks for.

    They know names, tags and hours. Single events (tables, scatter plots, undivided
    charts), info texts, numbers of results, mutated values and time ranges are
    beyond them; mutators on buckets are not, they come after the buckets.
    """
    bucketed = interval != "disabled"
    if widget.type not in WIDGETS or ranged or (bucketed and interval not in INTERVALS):
        return False
    if not bucketed and (widget.type in ("line_graph", "bar_graph") or any(s.mutators for s in widget.series)):
        return False
    if any(s.additional_info_filter for s in widget.series):
        return False
    return not any(sources[s.id].max_results or sources[s.id].last_unique_by_tag for s in widget.series)
