"""Streaming twins of batch queries, run over everything there is and then stopped."""

from __future__ import annotations

import uuid
from datetime import timedelta
from itertools import groupby
from operator import itemgetter

from pyspark.sql import functions as F

from catalog.base import (
    APP_NOW,
    EVENTS,
    USER,
    app_columns,
    bucket_sql,
    mean_sql,
    query,
    raw_events,
    user_columns,
)
from catalog.ingest import (
    ACCEPTED_SQL,
    JUDGED_SQL,
    LOG_CONFIG,
    PARSED_SQL,
    SKIP_PATTERN,
    SKIPPED_SQL,
    _rates_sql,
    counter_samples,
    log_lines,
    push_requests,
)
from tickloom.operators.retention import RetentionRule
from tickloom.session import fresh_dir, ship_package
from tickloom.sources import event_store, tail
from tickloom.sources.collectors import Collector, run_collectors
from tickloom.streaming import counters, ingest, live, windows


def event_stream(spark, sf):
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)


def _live_sql(interval: str, function: str) -> str:
    return f"""SELECT name, {bucket_sql(interval)} AS "timestamp", {function} AS value, count(*) AS n FROM
        (SELECT 'app_event' AS name, value, ts AS "timestamp" FROM events) GROUP BY 1, 2"""


@query(_live_sql("hour", mean_sql("avg(value)")))
def stream_interval_hour(spark, sf):
    target, checkpoint = fresh_dir(spark, "live"), fresh_dir(spark, "checkpoint")
    live.live_intervals(app_columns(event_stream(spark, sf)), "hour", target, checkpoint).awaitTermination()
    return live.read_intervals(spark, target, "hour", "average")


@query(_live_sql("week", "max(value)"))
def stream_interval_week(spark, sf):
    """Weeks put together from streamed days."""
    target, checkpoint = fresh_dir(spark, "live"), fresh_dir(spark, "checkpoint")
    live.live_intervals(app_columns(event_stream(spark, sf)), "week", target, checkpoint).awaitTermination()
    return live.read_intervals(spark, target, "week", "max")


@query(f"""SELECT name, tag, event_id, value, additional_info, "timestamp" FROM
    (SELECT *, row_number() OVER (PARTITION BY name, tag ORDER BY "timestamp" DESC, event_id DESC) AS place FROM {USER})
    WHERE place = 1""")
def stream_latest_by_tag(spark, sf):
    target, checkpoint = fresh_dir(spark, "live"), fresh_dir(spark, "checkpoint")
    live.live_latest_by_tag(user_columns(event_stream(spark, sf)), target, checkpoint).awaitTermination()
    return live.read_latest_by_tag(spark, target)


@query(_live_sql("hour", mean_sql("avg(value)")))
def stream_late_events(spark, sf):
    """Events of any age count, whatever batch they come with; done batches are merged in between."""
    inbox, target, checkpoint = (fresh_dir(spark, x) for x in ("inbox", "live", "checkpoint"))
    rows = app_columns(raw_events(spark, sf))
    for part in (1, 0, 2, 3):
        rows.where(F.col("event_id") % 4 == part).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        live.live_intervals(stream, "hour", target, checkpoint).awaitTermination()
        live.compact_intervals(spark, target, keep=1)
    return live.read_intervals(spark, target, "hour", "average")


def _without_ids(sql: str) -> str:
    return f'SELECT name, value, tag, additional_info, "timestamp" FROM ({sql})'


def _pushed(spark, sf, store):
    inbox = fresh_dir(spark, "inbox")
    push_requests(raw_events(spark, sf)).select("body").write.text(inbox)
    stream = ingest.text_stream(spark, inbox, files_per_batch=4)
    quarantine, checkpoint = fresh_dir(spark, "quarantine"), fresh_dir(spark, "checkpoint")
    ingest.push_stream(stream, store, quarantine, checkpoint, APP_NOW).awaitTermination()


def _tailed(spark, sf, store):
    inbox = fresh_dir(spark, "inbox")
    log_lines(raw_events(spark, sf)).select("line").repartition(4).write.text(inbox)
    stream = ingest.text_stream(spark, inbox, files_per_batch=2)
    ingest.tail_logs(stream, LOG_CONFIG, store, fresh_dir(spark, "checkpoint"), APP_NOW).awaitTermination()


PUSHED_SQL = f"{ACCEPTED_SQL} FROM {JUDGED_SQL} WHERE body_error IS NULL AND faults = 0"


@query(_without_ids(PUSHED_SQL))
def stream_push(spark, sf):
    store = fresh_dir(spark, "store")
    _pushed(spark, sf, store)
    return event_store.read_events(spark, store).drop("event_id")


@query(_without_ids(f"SELECT * FROM {PARSED_SQL}"))
def stream_log_tail(spark, sf):
    store = fresh_dir(spark, "store")
    _tailed(spark, sf, store)
    return event_store.read_events(spark, store).drop("event_id")


@query(f"""SELECT n, n AS ids FROM (SELECT (SELECT count(*) FROM ({PUSHED_SQL})) + (SELECT count(*) FROM {PARSED_SQL}) AS n)""")
def stream_ids(spark, sf):
    """Two streams into one event table: no id is given twice."""
    store = fresh_dir(spark, "store")
    _pushed(spark, sf, store)
    _tailed(spark, sf, store)
    ids = event_store.read_events(spark, store)
    return ids.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query(_without_ids(f"""SELECT * FROM {PARSED_SQL} WHERE "timestamp" >= TIMESTAMP '2024-01-21 00:00:00'"""))
def stream_retention(spark, sf):
    """Retention works on what a stream has written."""
    store = fresh_dir(spark, "store")
    _tailed(spark, sf, store)
    event_store.apply_retention(spark, store, [RetentionRule.parse({"event_name": "log_message", "max_age_days": 10})], APP_NOW)
    return event_store.read_events(spark, store).drop("event_id")


@query(_rates_sql("true"))
def stream_counter_rate(spark, sf):
    """Samples arrive out of order, dealt to batches by id."""
    inbox, target, checkpoint = (fresh_dir(spark, x) for x in ("inbox", "rates", "checkpoint"))
    samples = counter_samples(raw_events(spark, sf))
    for part in (2, 0, 1):
        samples.where(F.col("event_id") % 3 == part).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(samples.schema).parquet(inbox)
        live.live_counter_rates(stream, target, checkpoint).awaitTermination()
    return live.read_rates(spark, target).withColumn("value", F.col("value").cast("long"))


LATENESS = timedelta(hours=30)


def _out_of_order(spark, rows):
    """A folder that gets the rows in five parts by id, in an order of their own."""
    inbox = fresh_dir(spark, "inbox")
    for part in (1, 0, 4, 2, 3):
        yield inbox, rows.where(F.col("event_id") % 5 == part)


@query(f"""SELECT name, "timestamp", {mean_sql("avg(value)")} AS value, count(*) AS n FROM
    (SELECT 'app_event' AS name, date_trunc('hour', ts) AS "timestamp", value FROM events)
    WHERE "timestamp" + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {LATENESS // timedelta(hours=1)} HOURS FROM events) GROUP BY 1, 2""")
def stream_windows_and_late(spark, sf):
    """Windows as the watermark closes them, and events that came after: together the batch result of closed windows."""
    target, checkpoint = fresh_dir(spark, "windows"), fresh_dir(spark, "checkpoint")
    rows = app_columns(raw_events(spark, sf))
    for inbox, part in _out_of_order(spark, rows):
        part.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        windows.windowed_intervals(stream, "hour", target, checkpoint, LATENESS).awaitTermination()
    return windows.read_windows(spark, target, "hour", "average", with_late=True)


def _in_spans(spark, rows, parts=4):
    """A folder that gets the rows of one span of time after the other, up to an hour out of order."""
    inbox = fresh_dir(spark, "inbox")
    arrival = F.unix_micros("timestamp") + F.pmod("event_id", F.lit(3)) * 1_800_000_000
    low, high = rows.agg(F.min(arrival), F.max(arrival)).first()
    span = F.floor((arrival - low) * parts / (high - low + 1))
    for n in range(parts):
        yield inbox, rows.where(span == n)


STATE_LATENESS = timedelta(hours=2)


@query(f"""SELECT event_id, name, tag, value, "timestamp" FROM ({_rates_sql("true")})
    WHERE "timestamp" <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {STATE_LATENESS // timedelta(hours=1)} HOURS FROM events)""")
def stream_counter_rate_state(spark, sf):
    """Rates from the last reading of each counter alone, over four runs of one stream."""
    target, checkpoint = fresh_dir(spark, "rates"), fresh_dir(spark, "checkpoint")
    samples = counter_samples(raw_events(spark, sf))
    for inbox, part in _in_spans(spark, samples):
        part.repartition(3, "event_id").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(samples.schema).parquet(inbox)
        counters.state_counter_rates(stream, target, checkpoint, STATE_LATENESS).awaitTermination()
    return counters.read_state_rates(spark, target).withColumn("value", F.col("value").cast("long"))


def publish(spark, lines, folder, suffix=".log"):
    """The lines as one text file for each `file`, which take the place of files of that name.

    Tasks write the files, as the stream reads them; one gets its name when it is whole.
    """
    ship_package(spark)

    def write(batches):
        system, place = tail.opened(folder)
        system.create_dir(place)
        last = out = aside = None
        for batch in batches:
            names, rows = (batch.column(c).to_pylist() for c in ("file", "line"))
            for name, group in groupby(zip(names, rows, strict=True), key=itemgetter(0)):
                if out is None or name != last:
                    if out is not None:
                        out.close()
                        system.move(aside, f"{place}/{last}{suffix}")
                    last, aside = name, f"{place}/.{uuid.uuid4().hex}"
                    out = system.open_output_stream(aside)
                out.write("".join(f"{line or ''}\n" for _, line in group).encode())
            yield batch.select(["file"]).slice(0, 0)
        if out is not None:
            out.close()
            system.move(aside, f"{place}/{last}{suffix}")

    rows = lines.repartition("file").sortWithinPartitions("file", "pos").select(F.col("file").cast("string"), "line")
    rows.mapInArrow(write, "file string").count()


def _moved(spark, folder, old, new):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path(f"{folder}/{old}"), path(f"{folder}/{new}"))


def _grown(spark, sf):
    """A folder of four logs in two states: begun, and grown, rotated, cut and joined by a file that says it is old."""
    folder = fresh_dir(spark, "logs")
    lines = log_lines(raw_events(spark, sf)).withColumn("file", F.col("event_id") % 4)
    half = lines.agg(F.max("event_id") / 2).first()[0]
    early, grown = lines.where(F.col("pos") <= half), lines.where((F.col("file") == 0) | (F.col("pos") <= half * 1.5))
    publish(spark, early, folder)
    yield folder
    # 0 grows; 1 is rotated once it has grown, and its name begins anew; 2 is cut.
    publish(spark, grown.where("file in (0, 1)"), folder)
    _moved(spark, folder, "1.log", "1.log.1")
    publish(spark, lines.where((F.col("file") == 1) & (F.col("pos") > half * 1.5)), folder)
    publish(spark, lines.where((F.col("file") == 2) & (F.col("pos") > half)), folder)
    publish(spark, lines.where((F.col("file") == 3) & (F.col("pos") > half)), folder, ".late.log")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).setTimes(path(f"{folder}/3.late.log"), 1_500_000_000_000, -1)
    yield folder
    yield folder


@query(_without_ids(f"SELECT * FROM {PARSED_SQL}"))
def log_tail_offsets(spark, sf):
    """A collector that reads what was added to files, each byte once; its last run finds nothing new."""
    store, cursors, run_log, offsets = (fresh_dir(spark, x) for x in ("store", "cursors", "runs", "offsets"))
    for folder in _grown(spark, sf):
        config = LOG_CONFIG | {"log_file_path": folder, "offsets_path": offsets, "as_of": APP_NOW}
        collector = Collector.parse({"module": "logs_tail_collector", "config": config})
        run_collectors(spark, [collector], store, cursors, run_log, APP_NOW)
    return event_store.read_events(spark, store).drop("event_id")


@query(_without_ids(f"SELECT * FROM {PARSED_SQL}"))
def stream_log_offsets(spark, sf):
    """The same files as a stream of a Python data source."""
    store, checkpoint = fresh_dir(spark, "store"), fresh_dir(spark, "checkpoint")
    for folder in _grown(spark, sf):
        lines = tail.tail_stream(spark, folder)
        ingest.tail_logs(lines, LOG_CONFIG, store, checkpoint, APP_NOW).awaitTermination()
    return event_store.read_events(spark, store).drop("event_id")


@query(_without_ids(SKIPPED_SQL))
def stream_skip_until(spark, sf):
    """Files that grow while a stream waits for the line at which each of them begins."""
    folder, store, checkpoint = (fresh_dir(spark, x) for x in ("logs", "store", "checkpoint"))
    lines = log_lines(raw_events(spark, sf))
    for share in (100, 300, 700, 1000):
        publish(spark, lines.where(F.col("pos") % 1000 < share), folder)
        stream = tail.tail_stream(spark, folder)
        ingest.tail_logs(stream, LOG_CONFIG | {"skip_until": SKIP_PATTERN}, store, checkpoint, APP_NOW).awaitTermination()
    return event_store.read_events(spark, store).drop("event_id")
