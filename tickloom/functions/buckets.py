"""Time intervals: bucket expressions and calendar steps."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

# The interval names views use.
FIXED_INTERVALS = {"10m": 600, "30m": 1800, "hour": 3600}
CALENDAR_INTERVALS = ("day", "week", "month", "year")
INTERVALS = (*FIXED_INTERVALS, *CALENDAR_INTERVALS)
SELECTABLE = ("page_default", "disabled", *INTERVALS)

_STEP = {
    "10m": "INTERVAL 10 MINUTES",
    "30m": "INTERVAL 30 MINUTES",
    "hour": "INTERVAL 1 HOUR",
    "day": "INTERVAL 1 DAY",
    "week": "INTERVAL 7 DAYS",
    "month": "INTERVAL 1 MONTH",
    "year": "INTERVAL 1 YEAR",
}


def check_interval(interval: str) -> str:
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval!r}, expected one of {INTERVALS}")
    return interval


def bucket(ts: Column | str, interval: str) -> Column:
    """Start of the bucket holding `ts`.

    Sub-day intervals floor the epoch; longer ones follow the calendar of the
    session time zone, and weeks start on Monday.
    """
    check_interval(interval)
    ts = F.col(ts) if isinstance(ts, str) else ts
    if interval in FIXED_INTERVALS:
        us = F.unix_micros(ts)
        return F.timestamp_micros(us - F.pmod(us, F.lit(FIXED_INTERVALS[interval] * 1_000_000)))
    return F.date_trunc(interval, ts)


def step(interval: str) -> Column:
    """The interval as a Spark interval, for `sequence`."""
    return F.expr(_STEP[check_interval(interval)])


def days_before(moment: datetime, days: float) -> datetime:
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return moment - timedelta(days=days)
