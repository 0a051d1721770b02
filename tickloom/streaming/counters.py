"""Counter rates with keyed state: only what the next reading needs is kept.

`live.live_counter_rates` keeps all readings, so a reading of any age can be
worked in. Here each counter has its last reading that is final, the readings
that others may still come in front of, and timers, all in RocksDB:

* A reading is final when the watermark, which runs `lateness` behind the newest
  reading of earlier batches, has reached it. A timer at the first open reading
  fires then, and the rates of all readings that became final are emitted in
  order of time and id, each once.
* A reading at or before the watermark it meets is late. It lands beside the
  rates with the time it was late by, and changes nothing.
* A counter without a reading for `idle` leaves the state by a timer; its next
  reading begins anew, without a rate.

State grows with the counters that are alive and the readings of the lateness
interval, not with the stream, and no batch reads what has landed. A counter is
one key of the state: its readings of a batch go through one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tickloom.session import ship_package, stored
from tickloom.streaming.landing import land, landed, triggered
from tickloom.streaming.windows import keep_state_in_rocksdb

OUT_DDL = "side string, event_id long, name string, tag string, value double, timestamp timestamp, late_by_ms long"
RATE_DDL = "event_id long, name string, tag string, value double, timestamp timestamp"
LATE_DDL = f"{RATE_DDL}, late_by_ms long"
Out = Row(*[part.split()[0] for part in OUT_DDL.split(", ")])
READING = "event_id long, value double, at_us long"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
LONGEST = float(1 << 63)


def _moment(us: int) -> datetime:
    return EPOCH + timedelta(microseconds=us)


def _up_to_ms(us: int) -> int:
    """The first millisecond at which a watermark has reached a moment."""
    return -(-us // 1000)


def _order(reading: tuple) -> tuple:
    """By time, and by id where times are equal; a missing id comes first."""
    event_id, _, at_us = reading
    return at_us, event_id is not None, event_id or 0


def whole_rate(before: tuple, reading: tuple, on_reset: str) -> float | None:
    """Whole units per second between two readings, cut toward zero, as in the batch operator."""
    if before[1] is None or reading[1] is None or reading[2] == before[2]:
        return None
    grown = reading[1] - before[1]
    if on_reset == "null" and not grown >= 0:
        return None
    rate = grown / ((reading[2] - before[2]) / 1e6)
    return float(int(rate)) if -LONGEST <= rate < LONGEST else None


class RateProcessor(StatefulProcessor):
    """Readings of one counter in, rates of final readings and late readings out."""

    def __init__(self, on_reset: str = "keep", idle_ms: int | None = None):
        self.on_reset, self.idle_ms = on_reset, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", READING)
        self.open = handle.getListState("open", READING)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        mark_ms = timerValues.getCurrentWatermarkInMs()
        first = None
        for row in rows:
            reading = (row.event_id, row.value, row.at_us)
            if row.at_us <= mark_ms * 1000:
                late_by = mark_ms - _up_to_ms(row.at_us)
                yield Out("late", row.event_id, *key, row.value, _moment(row.at_us), late_by)
                continue
            self.open.appendValue(reading)
            first = row.at_us if first is None else min(first, row.at_us)
        if first is not None:
            self.handle.registerTimer(_up_to_ms(first))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        mark_ms = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(x) for x in self.open.get()), key=_order) if self.open.exists() else []
        final = [x for x in held if x[2] <= mark_ms * 1000]
        waiting = held[len(final) :]
        before = tuple(self.last.get()) if self.last.exists() else None
        for reading in final:
            if before is not None:
                yield Out("rate", reading[0], *key, whole_rate(before, reading, self.on_reset), _moment(reading[2]), None)
            before = reading
        if final:
            self.last.update(final[-1])
            if waiting:
                self.open.put(waiting)
                self.handle.registerTimer(_up_to_ms(waiting[0][2]))
            else:
                self.open.clear()
        if before is not None and not waiting and self.idle_ms is not None:
            gone_at = _up_to_ms(before[2]) + self.idle_ms
            if gone_at <= mark_ms:
                self.last.clear()
            else:
                self.handle.registerTimer(gone_at)

    def close(self) -> None:
        pass


def state_counter_rates(
    samples: DataFrame,
    target: str,
    checkpoint: str,
    lateness: timedelta = timedelta(hours=1),
    idle: timedelta | None = None,
    on_reset: str = "keep",
    interval_minutes: float | None = None,
) -> StreamingQuery:
    """Land the rates of readings as they become final, and late readings beside them.

    A gap longer than `idle` ends a counter; without it counters are kept for
    ever. Readings without a time are left out.
    """
    if on_reset not in ("keep", "null"):
        raise ValueError(f"unknown on_reset {on_reset!r}")
    ship_package(samples.sparkSession)
    keep_state_in_rocksdb(samples.sparkSession)
    ms = timedelta(milliseconds=1)
    # The watermark is told from `timestamp`. The processor gets a copy of it, of
    # which Spark knows no watermark, so late readings reach it and are not dropped.
    marked = samples.where("timestamp is not null").withWatermark("timestamp", f"{lateness // ms} milliseconds")
    readings = marked.select("event_id", "name", "tag", F.col("value").cast("double").alias("value"), F.unix_micros("timestamp").alias("at_us"))
    processor = RateProcessor(on_reset, None if idle is None else idle // ms)
    out = readings.groupBy("name", "tag").transformWithState(processor, OUT_DDL, "Append", "EventTime")

    def split(batch: DataFrame, batch_id: int) -> None:
        rows = stored(batch, "rates")
        names = lambda ddl: [part.split()[0] for part in ddl.split(", ")]
        land(rows.where("side = 'rate'").select(*names(RATE_DDL)), f"{target}/rates", batch_id)
        land(rows.where("side = 'late'").select(*names(LATE_DDL)), f"{target}/late", batch_id)

    writer = out.writeStream.outputMode("append").foreachBatch(split).option("checkpointLocation", checkpoint)
    return triggered(writer, interval_minutes).start()


def read_state_rates(spark: SparkSession, target: str) -> DataFrame:
    return landed(spark, f"{target}/rates", RATE_DDL).drop("batch_id")


def read_late_readings(spark: SparkSession, target: str) -> DataFrame:
    return landed(spark, f"{target}/late", LATE_DDL).drop("batch_id")
