"""The event frame: schema, literals, ordering and adapters."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

EVENT_SCHEMA = StructType(
    [
        StructField("event_id", LongType()),
        StructField("name", StringType()),
        StructField("value", DoubleType()),
        StructField("tag", StringType()),
        StructField("additional_info", StringType()),
        StructField("timestamp", TimestampType()),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

Instant = datetime | str | Column


def micros(moment: datetime | str) -> int:
    """Microseconds since the epoch; naive moments are read as UTC."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    since = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


def instant(moment: Instant) -> Column:
    """A timestamp literal that folds to a constant and reaches the scan."""
    if isinstance(moment, Column):
        return moment
    return F.timestamp_micros(F.lit(micros(moment)))


def order_key(ts: str = "timestamp", tie: str | None = "event_id") -> Column:
    """Chronological position, ties broken by `tie`, as one number.

    `max_by` over a struct would force a sort aggregate; a decimal has a
    fixed-width buffer, so Spark keeps the hash aggregate. Any long is a valid
    tie, and a missing one comes before all others of its moment.
    """
    if tie is None:
        return F.col(ts)
    shifted = F.unix_micros(ts).cast("decimal(18,0)") * F.expr("20000000000000000000BD")
    place = F.coalesce(F.col(tie).cast("decimal(19,0)") + F.expr("9223372036854775809BD"), F.expr("0BD"))
    return (shifted + place).cast("decimal(38,0)")


def normalize_events(
    df: DataFrame,
    mapping: Mapping[str, Column | str],
    as_of: Instant,
    value_mode: str = "double",
    complete: Collection[str] = (),
) -> DataFrame:
    """Project any table into the event frame and fill the defaults.

    `mapping` gives a column or column name per event field. A missing value
    becomes 0 and a missing timestamp `as_of`; tag and info stay NULL.
    `value_mode="int"` truncates values toward zero. Fields named in `complete`
    are never missing in this table: they are taken as they are, which lets
    filters on them reach the scan.
    """
    unknown = set(mapping) - set(EVENT_COLUMNS)
    if unknown:
        raise ValueError(f"not event fields: {sorted(unknown)}")
    if value_mode not in ("double", "int"):
        raise ValueError(f"unknown value_mode {value_mode!r}")

    def source(field: str, default: Column | None = None) -> Column:
        given = mapping.get(field)
        if given is None:
            return default if default is not None else F.lit(None)
        column = F.col(given) if isinstance(given, str) else given
        return column if default is None or field in complete else F.coalesce(column, default)

    value = source("value", F.lit(0)).cast("double")
    if value_mode == "int":
        value = value.cast("long").cast("double")
    columns = {
        "event_id": source("event_id", None if "event_id" in mapping else F.monotonically_increasing_id()),
        "name": source("name"),
        "value": value,
        "tag": source("tag"),
        "additional_info": source("additional_info"),
        "timestamp": source("timestamp", instant(as_of)),
    }
    return df.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA])


def gate_named(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split collector records into usable ones and ones without a name, null or empty."""
    has_name = F.coalesce(F.col("name") != "", F.lit(False))
    return records.where(has_name), records.where(~has_name)
