"""Small event frames for tests."""

from __future__ import annotations

from datetime import datetime, timezone

from tickloom.model import EVENT_SCHEMA


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def events(spark, rows):
    """Rows of (event_id, name, value, tag, additional_info, time text)."""
    return spark.createDataFrame([(*r[:5], at(r[5])) for r in rows], EVENT_SCHEMA)


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()
