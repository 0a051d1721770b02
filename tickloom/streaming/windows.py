"""Watermarked intervals: state that expires, and what came too late on the side.

`live.live_intervals` counts events of any age and keeps no state. Here a stream
keeps one row of state per open window, name and tag, in RocksDB. A watermark
runs `lateness` behind the newest event time of earlier batches; windows it has
passed are emitted once and leave the state, so the state does not grow with
the stream. Events of windows that are gone would be lost without a word; they
land beside the windows with the time they came late by, and readers may add
them. Emitted windows and late events together are the batch result of all
windows the watermark has passed.

Spark drops an event if its window ended at or before the watermark that the
batch before ran with. The batches land that mark themselves (the newest event
time they have seen), so the side output asks the same question of the same
number, whatever happens between two batches.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.buckets import CALENDAR_INTERVALS, bucket, check_interval
from tickloom.session import stored
from tickloom.streaming.landing import BATCH, compact, folders, hadoop_folder, land, landed, triggered
from tickloom.streaming.live import PARTIAL_DDL, compact_intervals, interval_values

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Windows of calendar intervals are days, which readers put together.
WINDOWS = {"10m": "10 minutes", "30m": "30 minutes", "hour": "1 hour"}
EVENT_DDL = "event_id long, name string, value double, tag string, additional_info string, timestamp timestamp"
LATE_DDL = f"{EVENT_DDL}, window_end timestamp, late_by_ms long"
MARK_DDL = "newest_before long, newest long"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State beyond the executors' heap, with checkpoints of changes only."""
    spark.conf.set(STATE_STORE, ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def window_of(interval: str) -> Column:
    check_interval(interval)
    return F.window("timestamp", WINDOWS.get(interval, "1 day"))


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _mark(spark: SparkSession, target: str, batch_id: int) -> tuple[int | None, int | None]:
    """Newest event times in microseconds: before the given batch, and up to it."""
    try:
        row = spark.read.schema(MARK_DDL).parquet(f"{target}/marks/{BATCH}{batch_id}").first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, None
    return (row.newest_before, row.newest) if row else (None, None)


def dropped_below(newest: int | None, lateness: timedelta) -> int:
    """The watermark, in milliseconds, that follows from a newest event time."""
    return 0 if newest is None else max(0, newest // 1000 - lateness // timedelta(milliseconds=1))


def windowed_intervals(
    events: DataFrame,
    interval: str,
    target: str,
    checkpoint: str,
    lateness: timedelta = timedelta(hours=1),
    interval_minutes: float | None = None,
) -> StreamingQuery:
    """Land windows as the watermark passes them, and late events beside them.

    The sums are made before the shuffle, so a name or tag with most of the
    events sends a row per task and window. The second branch of the stream is
    the events themselves, of which only late ones are written.
    """
    spark = events.sparkSession
    keep_state_in_rocksdb(spark)
    delay_ms = lateness // timedelta(milliseconds=1)
    marked = events.withWatermark("timestamp", f"{delay_ms} milliseconds")
    sums = marked.groupBy(window_of(interval).alias("window"), "name", "tag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    closed = sums.select(F.lit(True).alias("is_window"), F.col("window.start").alias("start"), "name", "tag", "n", "total", "low", "high")
    raw = events.select(F.lit(False).alias("is_window"), *_names(EVENT_DDL), window_of(interval)["end"].alias("window_end"))
    both = closed.unionByName(raw, allowMissingColumns=True)

    def split(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        before, newest = _mark(own, target, batch_id - 1)
        gone = dropped_below(before, lateness)
        watch = Observation()
        ended = F.unix_millis("window_end")
        seen = batch.observe(watch, F.max(F.when(~F.col("is_window"), F.unix_micros("timestamp"))).alias("newest"))
        # An event without a time is in no window.
        kept = stored(seen.where(F.col("is_window") | (ended <= gone)), "windows")
        land(kept.where("is_window").select(*_names(PARTIAL_DDL)), f"{target}/windows", batch_id)
        late = kept.where("not is_window").withColumn("late_by_ms", F.lit(gone) - ended)
        land(late.select(*_names(LATE_DDL)), f"{target}/late", batch_id)
        now = watch.get.get("newest")
        up_to = max((x for x in (newest, now) if x is not None), default=None)
        mark = own.createDataFrame([(newest, up_to)], MARK_DDL)
        mark.write.mode("overwrite").parquet(f"{target}/marks/{BATCH}{batch_id}")

    writer = both.writeStream.outputMode("append").foreachBatch(split).option("checkpointLocation", checkpoint)
    return triggered(writer, interval_minutes).start()


def _late_partials(late: DataFrame, interval: str) -> DataFrame:
    start = bucket("timestamp", interval if interval not in CALENDAR_INTERVALS else "day")
    return late.groupBy(start.alias("start"), "name", "tag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def read_late(spark: SparkSession, target: str) -> DataFrame:
    """Events that came after their window had gone, and how far the watermark was past its end."""
    return landed(spark, f"{target}/late", LATE_DDL)


def read_windows(
    spark: SparkSession, target: str, interval: str, function: str, by_tag: bool = False, with_late: bool = False
) -> DataFrame:
    """Interval values from emitted windows; `with_late` adds the events that came too late for them."""
    check_interval(interval)
    parts = landed(spark, f"{target}/windows", PARTIAL_DDL).drop("batch_id")
    if with_late:
        parts = parts.unionByName(_late_partials(read_late(spark, target), interval))
    return interval_values(parts, interval, function, by_tag)


def compact_windows(spark: SparkSession, target: str, keep: int = 2) -> None:
    """Merge what done batches have landed, and drop the marks no batch asks for any more."""
    compact_intervals(spark, f"{target}/windows", keep)
    compact(spark, f"{target}/late", LATE_DDL, lambda rows: rows, keep)
    for number in folders(spark, f"{target}/marks")[1][: -keep - 1]:
        place, fs = hadoop_folder(spark, f"{target}/marks/{BATCH}{number}")
        fs.delete(place, True)
