"""Live aggregates over event streams.

Every micro-batch lands what it adds: partial aggregates, newest events or
rates. Readers put the batches together, so an event counts whenever it
arrives, and no state is held between batches. `compact_*` keeps the number of
folders small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.buckets import CALENDAR_INTERVALS, bucket, check_interval
from tickloom.functions.numbers import round_half_up, steady_round
from tickloom.model import order_key
from tickloom.operators.metrics import counter_rates
from tickloom.session import stored
from tickloom.streaming.landing import compact, land, landed, newest_per_key, triggered

PARTIAL_DDL = "start timestamp, name string, tag string, n long, total double, low double, high double"
LATEST_DDL = "name string, tag string, event_id long, value double, additional_info string, timestamp timestamp"
READING_DDL = "event_id long, name string, tag string, value double, timestamp timestamp"
COUNTER = ("name", "tag")


def _each_batch(
    rows: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, interval_minutes: float | None
) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return triggered(writer, interval_minutes).start()


def live_intervals(
    events: DataFrame, interval: str, target: str, checkpoint: str, interval_minutes: float | None = None
) -> StreamingQuery:
    """Keep count, sum, min and max per bucket, name and tag up to date.

    All bucket functions are served from these four numbers, and weeks, months
    and years from days. Events of any age are counted, as in batch.
    """
    check_interval(interval)
    start = bucket("timestamp", interval if interval not in CALENDAR_INTERVALS else "day")

    def partials(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy(start.alias("start"), "name", "tag").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("value").alias("total"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
        land(sums, target, batch_id)

    return _each_batch(events, partials, checkpoint, interval_minutes)


def _merged_partials(parts: DataFrame) -> DataFrame:
    return parts.groupBy("start", "name", "tag").agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.max("batch_id").alias("batch_id"),
    )


def compact_intervals(spark: SparkSession, path: str, keep: int = 2) -> None:
    compact(spark, path, PARTIAL_DDL, _merged_partials, keep)


def read_intervals(
    spark: SparkSession, path: str, interval: str, function: str, by_tag: bool = False
) -> DataFrame:
    """Interval values from the landed partials, as in the batch operator."""
    check_interval(interval)
    return interval_values(landed(spark, path, PARTIAL_DDL), interval, function, by_tag)


def interval_values(parts: DataFrame, interval: str, function: str, by_tag: bool = False) -> DataFrame:
    """Interval values from partials; weeks, months and years from those of days."""
    if interval in CALENDAR_INTERVALS and interval != "day":
        start = bucket("start", interval)
    else:
        start = F.col("start")
    keys = ["name", "tag"] if by_tag else ["name"]
    n, mean = F.sum("n"), F.sum("total") / F.sum("n")
    values = {
        "sum": F.sum("total"),
        "average": steady_round(mean, 4),
        "average_round": round_half_up(F.round(mean, 9)),
        "max": F.max("high"),
        "min": F.min("low"),
        "count": n.cast("double"),
    }
    if function not in values:
        raise ValueError(f"unknown bucket function {function!r}")
    return parts.groupBy(*keys, start.alias("timestamp")).agg(values[function].alias("value"), n.alias("n"))


def _newest(events: DataFrame, with_batch: bool = False) -> DataFrame:
    key = order_key()
    batch = [F.max("batch_id").alias("batch_id")] if with_batch else []
    return events.groupBy("name", "tag").agg(
        F.max_by("event_id", key).alias("event_id"),
        F.max_by("value", key).alias("value"),
        F.max_by("additional_info", key).alias("additional_info"),
        F.max("timestamp").alias("timestamp"),
        *batch,
    )


def live_latest_by_tag(
    events: DataFrame, target: str, checkpoint: str, interval_minutes: float | None = None
) -> StreamingQuery:
    """Keep the newest event of every name and tag up to date."""

    def latest(batch: DataFrame, batch_id: int) -> None:
        land(_newest(batch.where(F.col("tag").isNotNull())), target, batch_id)

    return _each_batch(events, latest, checkpoint, interval_minutes)


def compact_latest_by_tag(spark: SparkSession, path: str, keep: int = 2) -> None:
    compact(spark, path, LATEST_DDL, lambda rows: _newest(rows, with_batch=True), keep)


def read_latest_by_tag(spark: SparkSession, path: str) -> DataFrame:
    return _newest(landed(spark, path, LATEST_DDL))


def live_counter_rates(
    samples: DataFrame,
    target: str,
    checkpoint: str,
    on_reset: str = "keep",
    interval_minutes: float | None = None,
) -> StreamingQuery:
    """Rates of cumulative counters across micro-batches.

    `target` holds the readings, the last reading of each counter, and the
    rates, by batch. A batch that only brings newer readings runs through the
    batch operator behind the last ones. Counters that get a reading at or
    before one they had are worked out anew from all their readings, and these
    rates take the place of the earlier ones, so the result does not depend on
    how readings were dealt to batches.
    """
    spark = samples.sparkSession
    columns = [part.split()[0] for part in READING_DDL.split(", ")]
    key = order_key()

    def derive(batch: DataFrame, batch_id: int) -> None:
        land(batch.select(*columns), f"{target}/readings", batch_id)
        readings = landed(spark, f"{target}/readings", READING_DDL)
        fresh = readings.where(F.col("batch_id") == batch_id).select(*columns)
        last = _last_readings(landed(spark, f"{target}/last", READING_DDL).where(F.col("batch_id") < batch_id))
        seen = last.select(*[F.col(c).alias(f"_{c}") for c in COUNTER], key.alias("_seen"))
        same = F.col("name").eqNullSafe(F.col("_name")) & F.col("tag").eqNullSafe(F.col("_tag"))
        late = fresh.join(seen, same).where(key <= F.col("_seen")).select("_name", "_tag").distinct()
        late = stored(late, "late-counters")
        behind = last.select(*columns).unionByName(fresh).join(late, same, "left_anti")
        anew = readings.where(F.col("batch_id") <= batch_id).select(*columns).join(late, same, "left_semi")
        rates = counter_rates(behind.unionByName(anew), list(COUNTER), on_reset)
        land(rates.withColumn("value", F.col("value").cast("double")), f"{target}/rates", batch_id)
        land(_last_readings(fresh), f"{target}/last", batch_id)

    return _each_batch(samples, derive, checkpoint, interval_minutes)


def _last_readings(readings: DataFrame, with_batch: bool = False) -> DataFrame:
    key = order_key()
    batch = [F.max("batch_id").alias("batch_id")] if with_batch else []
    return readings.groupBy(*COUNTER).agg(
        F.max_by("event_id", key).alias("event_id"),
        F.max_by("value", key).alias("value"),
        F.max("timestamp").alias("timestamp"),
        *batch,
    )


def _newest_rates(rates: DataFrame) -> DataFrame:
    return newest_per_key(rates, ["event_id", *COUNTER])


def compact_rates(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Merge the rates and last readings of batches that are done."""
    compact(spark, f"{path}/rates", READING_DDL, _newest_rates, keep)
    compact(spark, f"{path}/last", READING_DDL, lambda rows: _last_readings(rows, with_batch=True), keep)
    compact(spark, f"{path}/readings", READING_DDL, lambda rows: rows, keep)


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """The rate of each reading as worked out last."""
    return _newest_rates(landed(spark, f"{path}/rates", READING_DDL)).drop("batch_id")
