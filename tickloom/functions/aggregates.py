"""Scalar aggregates over the events of one series."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickloom.functions.numbers import round_half_up, steady_round
from tickloom.model import order_key

# The aggregate and bucket function names views use.
SCALAR_KINDS = (
    "last",
    "first",
    "average",
    "average_round",
    "sum",
    "max",
    "min",
    "count",
    "first_datetime",
    "last_datetime",
    "diff_last_first",
    "diff_max_min",
)
BUCKET_KINDS = ("sum", "average", "average_round", "max", "min", "count")


def aggregate(
    kind: str,
    value: str = "value",
    ts: str = "timestamp",
    tie: str | None = "event_id",
) -> Column:
    """Aggregate expression for `kind`; all kinds run in one hash aggregate."""
    x = F.col(value)
    if kind == "last":
        return F.max_by(x, order_key(ts, tie))
    if kind == "first":
        return F.min_by(x, order_key(ts, tie))
    if kind == "average":
        return steady_round(F.avg(x), 4)
    if kind == "average_round":
        return round_half_up(F.round(F.avg(x), 9))
    if kind == "sum":
        return F.sum(x)
    if kind == "max":
        return F.max(x)
    if kind == "min":
        return F.min(x)
    if kind == "count":
        return F.count(F.lit(1))
    if kind == "first_datetime":
        return F.min(ts)
    if kind == "last_datetime":
        return F.max(ts)
    if kind == "diff_last_first":
        return F.max_by(x, order_key(ts, tie)) - F.min_by(x, order_key(ts, tie))
    if kind == "diff_max_min":
        return F.max(x) - F.min(x)
    raise ValueError(f"unknown aggregate {kind!r}, expected one of {SCALAR_KINDS}")


def bucket_aggregate(kind: str, value: str = "value") -> Column:
    """Aggregate expression for interval buckets, always a double."""
    if kind not in BUCKET_KINDS:
        raise ValueError(f"unknown bucket function {kind!r}, expected one of {BUCKET_KINDS}")
    return aggregate(kind, value).cast("double")
