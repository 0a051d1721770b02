"""Streams over several files and restarts, against their batch twins."""

from __future__ import annotations

from datetime import datetime

import pytest
from helpers import at, events
from pyspark.sql import functions as F

from catalog.base import user
from catalog.ingest import LOG_CONFIG, counter_samples
from tickloom.model import EVENT_SCHEMA
from tickloom.operators.metrics import counter_rates
from tickloom.operators.retrieve import latest_by_tag
from tickloom.operators.timeseries import interval_aggregate
from tickloom.sources import event_store
from tickloom.streaming import ingest, landing, live

NOW = datetime(2024, 1, 31)
EVENT_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_SCHEMA)


@pytest.fixture
def dirs(tmp_path):
    return lambda name: str(tmp_path / name)


def stream(spark, path, files=1):
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


@pytest.fixture
def split_events(spark, sf_dir, dirs):
    """User events as five files in time order."""
    path = dirs("in")
    for day in range(1, 31, 6):
        part = user(spark, sf_dir).where(F.dayofmonth("timestamp").between(day, day + 5))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("interval", ["10m", "day", "month"])
def test_live_intervals(spark, sf_dir, split_events, dirs, interval):
    target = dirs("out")
    live.live_intervals(stream(spark, split_events), interval, target, dirs("cp")).awaitTermination()
    for function in ("sum", "average", "average_round", "max", "min", "count"):
        got = live.read_intervals(spark, target, interval, function, by_tag=True)
        want = interval_aggregate(user(spark, sf_dir), interval, function, ["name", "tag"])
        columns = ["name", "tag", "timestamp", F.round("value", 4), "n"]
        assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect()), function
    with pytest.raises(ValueError):
        live.read_intervals(spark, target, interval, "median")


def test_late_rows_count_and_batches_are_merged(spark, dirs):
    path, target = dirs("in"), dirs("out")
    rows = [(1, "n", 1.0, "t", None, "2024-01-01T10:00:00"), (2, "n", 1.0, "t", None, "2024-01-03T00:00:00")]
    late = [(3, "n", 5.0, "t", None, "2024-01-01T10:30:00"), (4, "n", 7.0, "t", None, "2024-01-02T23:59:00")]
    for part in (rows, late, rows):
        events(spark, part).coalesce(1).write.mode("append").parquet(path)
        live.live_intervals(stream(spark, path), "hour", target, dirs("cp")).awaitTermination()
        got = [sorted((r.timestamp.hour, r.value) for r in live.read_intervals(spark, target, "hour", "sum").collect())]
        live.compact_intervals(spark, target, keep=1)
        got.append(sorted((r.timestamp.hour, r.value) for r in live.read_intervals(spark, target, "hour", "sum").collect()))
        assert got[0] == got[1]
    assert got[0] == [(0, 2.0), (10, 7.0), (23, 7.0)]
    assert landing.folders(spark, target) == (1, [2])


def test_live_latest_by_tag(spark, sf_dir, split_events, dirs):
    target = dirs("out")
    live.live_latest_by_tag(stream(spark, split_events), target, dirs("cp")).awaitTermination()
    got = live.read_latest_by_tag(spark, target).where("name = 'user_view'").select(EVENT_SCHEMA.fieldNames())
    want = latest_by_tag(user(spark, sf_dir), "user_view", ties="one")
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2)])
def test_live_rates_across_batches_and_restarts(spark, sf_dir, dirs, order):
    path, target = dirs("in"), dirs("out")
    samples = counter_samples(spark.read.schema("event_id long, ts timestamp, user_id long").parquet(f"{sf_dir}/events.parquet"))
    samples = samples.withColumn("tag", F.when(F.col("tag") != "3", F.col("tag")))
    moment = samples.where("event_id = 5").first()
    same = samples.where("event_id = 5").withColumn("event_id", F.lit(5000).cast("long"))
    for part in order:
        samples.where(F.col("event_id").between(part * 250, part * 250 + 249)).coalesce(1).write.mode("append").parquet(path)
        readings = spark.readStream.schema(samples.schema).parquet(path)
        live.live_counter_rates(readings, target, dirs("cp")).awaitTermination()
        live.compact_rates(spark, target)
    # A reading of a moment there was before, with a higher id.
    same.write.mode("append").parquet(path)
    live.live_counter_rates(spark.readStream.schema(samples.schema).parquet(path), target, dirs("cp")).awaitTermination()
    got = live.read_rates(spark, target).select("event_id", "tag", F.col("value").cast("long"))
    want = counter_rates(samples.unionByName(same), bounded=True).select("event_id", "tag", "value")
    assert moment is not None
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_a_repeated_batch_lands_once(spark, dirs):
    frame = events(spark, [(1, "n", 1.0, "t", None, "2024-01-01")])
    for _ in range(2):
        landing.land(frame, dirs("out"), 7)
    assert landing.landed(spark, dirs("out"), EVENT_DDL).count() == 1
    assert landing.landed(spark, dirs("none"), EVENT_DDL).count() == 0


def test_tail_logs_picks_up_new_files(spark, tmp_path, dirs):
    inbox = tmp_path / "in"
    inbox.mkdir()
    line = "2024-01-02T03:04:0{}.500 #ERROR# mod1 -> text {}\n"
    for n in range(3):
        (inbox / f"{n}.log").write_text("".join(line.format(i, n) for i in range(n + 1)) + "junk\n")
        text = ingest.text_stream(spark, str(inbox), files_per_batch=1)
        ingest.tail_logs(text, LOG_CONFIG, dirs("out"), dirs("cp"), NOW).awaitTermination()
    rows = event_store.read_events(spark, dirs("out")).collect()
    assert sorted(r.additional_info for r in rows) == ["text 0"] + ["text 1"] * 2 + ["text 2"] * 3
    assert len({r.event_id for r in rows}) == 6


def test_push_stream_separates_good_and_bad(spark, tmp_path, dirs):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text('{"events":[{"name":"a"},{"name":"b","value":2}]}\n{"events":[{"name":"c"},5]}\nnope\n')
    text = ingest.text_stream(spark, str(inbox))
    ingest.push_stream(text, dirs("good"), dirs("bad"), dirs("cp"), NOW).awaitTermination()
    good = event_store.read_events(spark, dirs("good")).collect()
    assert sorted((r.name, r.value, r.timestamp) for r in good) == [
        (n, v, at("2024-01-31").replace(tzinfo=None)) for n, v in (("a", 0.0), ("b", 2.0))
    ]
    bad = ingest.landed_quarantine(spark, dirs("bad")).collect()
    assert sorted(str(r.pos) for r in bad) == ["1", "None"]


def test_ids_of_a_long_push_stream(spark, tmp_path, dirs):
    """Over twenty batches, one with a document of more than 65,536 events."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    for n in range(22):
        many = 70_000 if n == 3 else 2
        (inbox / f"{n:02d}.json").write_text('{"events":[' + ",".join(['{"name":"a"}'] * many) + "]}\n")
    text = ingest.text_stream(spark, str(inbox), files_per_batch=1)
    ingest.push_stream(text, dirs("good"), dirs("bad"), dirs("cp"), NOW).awaitTermination()
    rows = event_store.read_partitions(spark, dirs("good")).select("event_id", "write").collect()
    assert len(rows) == len({r.event_id for r in rows}) == 70_000 + 21 * 2
    by_write = sorted((r.write, r.event_id) for r in rows)
    assert [i for _, i in by_write] == sorted(i for _, i in by_write) and by_write[0][1] > 0


def test_triggers(spark, dirs):
    frame = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", dirs("cp"))
    query = landing.triggered(frame, 0.5).start()
    try:
        assert query.isActive
    finally:
        query.stop()
