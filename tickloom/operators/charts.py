"""Widget results other than tables. Each function returns one DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.aggregates import aggregate
from tickloom.functions.numbers import leading_number, steady_round
from tickloom.operators.timeseries import fill_axis, raw_points

# Gauge zones used when a config names none.
DEFAULT_ZONES = ((30, "#67e0e3"), (70, "#37a2da"), (100, "#fd666d"))


# The expression of an aggregate by its name: over events, or over partials of them.
Aggregate = Callable[[str], Column]


def scalar_by_series(df: DataFrame, kind: str, expression: Aggregate = aggregate) -> DataFrame:
    """One aggregate per series; series without events have no row."""
    return df.groupBy("series_idx").agg(expression(kind).alias("value"))


def counter(df: DataFrame, kind: str, expression: Aggregate = aggregate) -> DataFrame:
    return scalar_by_series(df, kind, expression).select("value")


def gauge_zone(
    value: Column,
    zones: Sequence[Sequence[Any]] | None = None,
    low: float = 0,
    high: float = 100,
) -> Column:
    """First zone whose upper threshold (0..100) covers the value, else the last one."""
    zones = zones or DEFAULT_ZONES
    span = float(high - low)
    share = (value - low) / span * 100 if span else F.when(value > low, 100.0).otherwise(0.0)
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))
    zone = F.when(share <= min(100.0, max(0.0, float(zones[0][0]))), F.lit(str(zones[0][1])))
    for threshold, color in zones[1:]:
        zone = zone.when(share <= min(100.0, max(0.0, float(threshold))), F.lit(str(color)))
    return zone.otherwise(F.lit(str(zones[-1][1])))


def gauge(
    df: DataFrame,
    kind: str = "last",
    zones: Sequence[Sequence[Any]] | None = None,
    low: float = 0,
    high: float = 100,
    expression: Aggregate = aggregate,
) -> DataFrame:
    """Gauge reading: magnitude of the aggregate, its zone, time of the last event."""
    reading = df.groupBy("series_idx").agg(
        F.abs(F.coalesce(expression(kind), F.lit(0.0))).alias("value"), expression("last_datetime").alias("last_time")
    )
    return reading.select("value", gauge_zone(F.col("value"), zones, low, high).alias("zone"), "last_time")


def pie(df: DataFrame, labels: Sequence[str], kind: str = "sum", expression: Aggregate = aggregate) -> DataFrame:
    """One slice per series: magnitude, total and percentage; empty series give 0.

    The slice list is the widget's series list, so the join, the total and the
    window behind it all run on a handful of rows.
    """
    spark = df.sparkSession
    slices = spark.range(1, numPartitions=1).select(
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("series_idx"), F.lit(s).alias("label")) for i, s in enumerate(labels)])
        ).alias("slice")
    )
    slices = slices.select("slice.series_idx", "slice.label")
    sized = slices.join(scalar_by_series(df, kind, expression), "series_idx", "left").select(
        "series_idx", "label", F.abs(F.coalesce(F.col("value"), F.lit(0))).cast("double").alias("value")
    )
    total = F.sum("value").over(Window.partitionBy())
    share = F.when(F.col("total") != 0, steady_round(F.col("value") / F.col("total") * 100, 2))
    return sized.withColumn("total", total).withColumn("share", share).orderBy("series_idx")


def time_chart(
    df: DataFrame,
    interval: str,
    as_of: datetime,
    max_age_days: float | None,
    series: Sequence[int],
    default: float | None,
) -> DataFrame:
    """Line (`default=None`) or bar (`default=0`) points.

    `df` holds interval values, or raw events when the interval is disabled.
    """
    if interval == "disabled":
        return raw_points(df, default)
    return fill_axis(df, interval, as_of, max_age_days, series, default)


def scatter(df: DataFrame) -> DataFrame:
    """Points per series: x is the number the info text starts with, else the time in ms."""
    return df.select(
        "series_idx",
        F.coalesce(leading_number(F.col("additional_info")), F.unix_millis("timestamp").cast("double")).alias("x"),
        F.when(F.isnan("value"), F.lit(0.0)).otherwise(F.coalesce("value", F.lit(0.0))).alias("y"),
    )


def scatter_pairs(values: DataFrame) -> DataFrame:
    """Interval values of series 0 and 1 as x and y of the buckets both have."""
    of = {i: F.max(F.when(F.col("series_idx") == i, F.col("value"))) for i in (0, 1)}
    pairs = values.groupBy("timestamp").agg(of[0].alias("x"), of[1].alias("y"))
    return pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
