"""Derivations on raw metric samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.operators.ordered import with_previous

BYTES_PER_MB = 1024 * 1024


def counter_rates(
    samples: DataFrame,
    keys: Sequence[str] = ("name", "tag"),
    on_reset: str = "keep",
    bounded: bool = False,
) -> DataFrame:
    """Cumulative counter -> whole units per second since the previous sample.

    The first sample of a counter gives no rate. A counter that went back gives
    a negative rate, or NULL with `on_reset="null"`; so do two samples at the
    same moment.
    """
    if on_reset not in ("keep", "null"):
        raise ValueError(f"unknown on_reset {on_reset!r}")
    paired = with_previous(samples, ["value", "timestamp"], keys, bounded=bounded)
    paired = paired.where(F.col("prev_timestamp").isNotNull())
    return paired.withColumn("value", rate("value", "timestamp", on_reset)).drop("prev_value", "prev_timestamp")


def rate(value: str, ts: str, on_reset: str = "keep") -> Column:
    """Rate against the `prev_` columns, truncated to a whole number."""
    grown = F.col(value) - F.col(f"prev_{value}")
    seconds = (F.unix_micros(ts) - F.unix_micros(f"prev_{ts}")) / 1e6
    per_second = F.when(seconds != 0, (grown / seconds).try_cast("long"))
    return F.when(grown >= 0, per_second) if on_reset == "null" else per_second


def sample_events(samples: DataFrame, columns: Mapping[str, str], ids: Sequence[str]) -> DataFrame:
    """One wide sample -> one event per measured column, named by `columns`."""
    cast = samples.select(*ids, *[F.col(c).cast("double").alias(name) for c, name in columns.items()])
    return cast.unpivot(list(ids), list(columns.values()), "name", "value")


def to_mb(x: Column, how: str = "truncate") -> Column:
    """Bytes to whole megabytes, cutting toward zero or rounding down."""
    if how not in ("truncate", "floor"):
        raise ValueError(f"unknown how {how!r}")
    mb = x / float(BYTES_PER_MB)
    return (mb if how == "truncate" else F.floor(mb)).try_cast("long")


def busy_percent(idle: Column) -> Column:
    """100 - idle, kept within 0..100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - idle))


def composite_tag(metric: Column, dimension: str, instance: Column) -> Column:
    """`metric,dimension:instance`, or just the metric without an instance."""
    return F.when(instance.isNull(), metric).otherwise(F.concat(metric, F.lit(f",{dimension}:"), instance))


def split_tag(tag: Column) -> tuple[Column, Column, Column]:
    """Metric, dimension and instance of a composite tag (NULL where absent)."""
    metric = F.split_part(tag, F.lit(","), F.lit(1))
    rest = F.when(F.contains(tag, F.lit(",")), F.regexp_extract(tag, r"^[^,]*,(.*)$", 1))
    dimension = F.when(F.contains(rest, F.lit(":")), F.regexp_extract(rest, r"^([^:]*):", 1))
    instance = F.when(F.contains(rest, F.lit(":")), F.regexp_extract(rest, r"^[^:]*:(.*)$", 1))
    return metric, dimension, instance
