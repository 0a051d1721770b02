"""Interval aggregation, time axes and gap filling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.aggregates import bucket_aggregate
from tickloom.functions.buckets import (
    FIXED_INTERVALS,
    bucket,
    check_interval,
    days_before,
    step,
)
from tickloom.model import instant
from tickloom.operators.ordered import place_in_groups


def interval_aggregate(
    df: DataFrame,
    interval: str | None,
    function: str = "sum",
    keys: Sequence[str] = ("series_idx", "name"),
) -> DataFrame:
    """One row per key and time bucket: bucket start, value and event count.

    "disabled" leaves the rows as they are.
    """
    if not interval or interval == "disabled":
        return df
    return interval_table(df, interval, {"value": function}, keys)


def interval_table(
    df: DataFrame, interval: str, functions: Mapping[str, str], keys: Sequence[str]
) -> DataFrame:
    """Several bucket functions in one pass, as output column -> function.

    Partial aggregation shrinks every task's output to its buckets before the
    shuffle, so a bucket with most of the rows costs no more than the others.
    """
    values = [bucket_aggregate(function).alias(column) for column, function in functions.items()]
    grouped = df.groupBy(*keys, bucket("timestamp", interval).alias("timestamp"))
    return grouped.agg(*values, F.count(F.lit(1)).alias("n"))


def raw_points(df: DataFrame, default: float | None = None) -> DataFrame:
    """Unaggregated chart points in time order; rows without a time are left out."""
    value = F.col("value") if default is None else F.coalesce("value", F.lit(default))
    points = df.where(F.col("timestamp").isNotNull())
    return points.select("series_idx", "timestamp", "event_id", value.alias("value")).orderBy(
        "series_idx", "timestamp", "event_id"
    ).drop("event_id")


def oldest_max_age(ages: Sequence[float | None]) -> float | None:
    """The longest positive age limit among a widget's sources."""
    limited = [a for a in ages if a and a > 0]
    return max(limited) if limited else None


def axis_start(
    values: DataFrame, interval: str, as_of: datetime, max_age_days: float | None
) -> Column:
    """Start of the axis: the age limit, else the first value, floored."""
    if max_age_days:
        return bucket(instant(days_before(as_of, max_age_days)), interval)
    return bucket(values.agg(F.min("timestamp")).scalar(), interval)


def time_spine(
    values: DataFrame,
    interval: str,
    as_of: datetime,
    max_age_days: float | None,
    series: Sequence[int],
) -> DataFrame:
    """Every bucket up to `as_of` for every series.

    Without an age limit the axis begins at the first value; with neither there
    is no axis. Short steps are made day by day, and the days are dealt out, so
    a long axis is built by many tasks.
    """
    check_interval(interval)
    spark = values.sparkSession
    bounds = spark.range(1, numPartitions=1).select(
        axis_start(values, interval, as_of, max_age_days).alias("start"), instant(as_of).alias("end")
    )
    bounds = bounds.where(F.col("start") <= F.col("end"))
    if interval in FIXED_INTERVALS:
        days = bounds.select(F.explode(F.sequence("start", "end", step("day"))).alias("day"), "end").repartition("day")
        last = F.least(F.col("end"), F.col("day") + step("day") - step(interval))
        points = days.select(F.explode(F.sequence("day", last, step(interval))).alias("timestamp"))
    else:
        points = bounds.select(F.explode(F.sequence("start", "end", step(interval))).alias("timestamp"))
    return points.select(F.explode(F.array(*[F.lit(i) for i in series])).alias("series_idx"), "timestamp")


def pairwise_mean(values: Column) -> Column:
    """Fold time-ordered (timestamp, value) pairs by averaging each with the result so far."""
    ordered = F.sort_array(values)
    rest = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(ordered, 1)["value"], lambda acc, p: (acc + p["value"]) / 2)


def combine_on_axis(values: DataFrame, slot: Column, value: str = "value", bounded: bool = False) -> DataFrame:
    """Bring interval values onto axis slots, folding several values of a slot: each
    is averaged with the result of those before it.

    Averaging with a value is the map x -> x / 2 + value / 2, and n such maps one
    after the other are x -> x / 2^n + b. The rows are sorted by range, each part
    of a slot becomes one such map, and the maps of the parts are put together, so
    a slot of any size is spread over tasks. The first value is what the maps start
    from (averaged with itself it stays what it is).

    `bounded=True` says a slot has few values (buckets of one series); then these
    are gathered by slot.
    """
    rows = values.select("series_idx", slot.alias("slot"), "timestamp", F.col(value).alias("value"))
    if bounded:
        pairs = F.collect_list(F.struct("timestamp", "value"))
        return rows.groupBy("series_idx", "slot").agg(pairwise_mean(pairs).alias("value"))
    keys = ["series_idx", "slot"]
    placed = place_in_groups(rows, keys, ["timestamp", "value"])
    share = F.col("value") / F.pow(F.lit(2.0), F.col("_behind") + 1)
    maps = placed.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(share).alias("b"), F.max(F.when(F.col("_rank") == 1, F.col("value"))).alias("first")
    )
    # One row per part of a slot from here on.
    later = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    behind = F.coalesce(F.sum("n").over(later), F.lit(0))
    maps = maps.withColumn("behind", behind)
    start = F.min_by("first", "_part") / F.pow(F.lit(2.0), F.sum("n"))
    return maps.groupBy(*keys).agg((start + F.sum(F.col("b") / F.pow(F.lit(2.0), "behind"))).alias("value"))


def fixed_step_slot(ts: Column, origin: datetime, step_days: float) -> Column:
    """Slot start on an axis of equal steps from `origin`."""
    step_us = int(step_days * 86_400_000_000)
    offset = F.unix_micros(ts) - F.unix_micros(instant(origin))
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(offset, F.lit(step_us)))


def fill_axis(
    values: DataFrame,
    interval: str,
    as_of: datetime,
    max_age_days: float | None,
    series: Sequence[int],
    default: float | None = None,
) -> DataFrame:
    """Interval values of every series on the full axis; gaps get `default`.

    Values before the axis are left out. The last bucket is open-ended, so
    values dated after `as_of` fold into it.
    """
    spine = time_spine(values, interval, as_of, max_age_days, series)
    last = bucket(instant(as_of), interval)
    placed = combine_on_axis(values, F.least(F.col("timestamp"), last), bounded=True)
    filled = spine.join(
        placed.withColumnRenamed("slot", "timestamp"), ["series_idx", "timestamp"], "left"
    )
    value = F.col("value") if default is None else F.coalesce("value", F.lit(float(default)))
    return filled.select("series_idx", "timestamp", value.alias("value")).orderBy("series_idx", "timestamp")


