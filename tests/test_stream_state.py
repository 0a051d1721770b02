"""Watermarked windows and keyed counter state: what is emitted, what is late, what stays."""

from __future__ import annotations

import json
from datetime import timedelta

import pytest
from helpers import events
from pyspark.sql import functions as F

from tickloom.model import EVENT_SCHEMA
from tickloom.operators.metrics import counter_rates
from tickloom.streaming import counters, landing, windows

HOUR = timedelta(hours=1)


@pytest.fixture
def dirs(tmp_path):
    return lambda name: str(tmp_path / name)


def stream(spark, path):
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def put(spark, path, rows):
    events(spark, rows).coalesce(1).write.mode("append").parquet(path)


def event(number, when, value=1.0, tag="t", name="n"):
    return (number, name, value, tag, None, when)


def progress(query):
    """Finished batches; progress comes as JSON text or as an object."""
    return [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]


def landed_sums(spark, target, with_late=False):
    rows = windows.read_windows(spark, target, "hour", "sum", by_tag=True, with_late=with_late).collect()
    return sorted((r.timestamp.strftime("%dT%H"), r.tag, r.value, r.n) for r in rows)


def test_windows_are_emitted_once_and_late_events_land(spark, dirs):
    path, target, checkpoint = dirs("in"), dirs("out"), dirs("cp")

    def run(rows):
        put(spark, path, rows)
        query = windows.windowed_intervals(stream(spark, path), "hour", target, checkpoint, 2 * HOUR)
        query.awaitTermination()
        return query

    run([event(1, "2024-01-01T10:10"), event(2, "2024-01-01T10:20", 5.0), event(3, "2024-01-01T12:30", tag=None)])
    assert landed_sums(spark, target) == []
    # Within the lateness: an event of an open window from before.
    run([event(4, "2024-01-01T10:59", 7.0), event(5, "2024-01-01T13:30", tag="u")])
    assert landed_sums(spark, target) == [("01T10", "t", 13.0, 3)]
    # Too late by half an hour, and not late: the window of 11 o'clock ends at 12:00.
    run([event(6, "2024-01-01T10:01", 100.0), event(7, "2024-01-01T11:59"), event(8, "2024-01-01T14:10")])
    assert landed_sums(spark, target) == [("01T10", "t", 13.0, 3), ("01T11", "t", 1.0, 1)]
    late = windows.read_late(spark, target).collect()
    assert [(r.event_id, r.value, r.late_by_ms) for r in late] == [(6, 100.0, 30 * 60 * 1000)]
    assert landed_sums(spark, target, with_late=True)[0] == ("01T10", "t", 113.0, 4)
    before = landed_sums(spark, target, with_late=True)
    windows.compact_windows(spark, target, keep=1)
    assert landed_sums(spark, target, with_late=True) == before
    assert len(landing.folders(spark, f"{target}/windows")[1]) == 1 and len(landing.folders(spark, f"{target}/marks")[1]) == 2
    run([event(9, "2024-01-03T00:00")])
    emitted = landed_sums(spark, target)
    assert len(emitted) == 5 and ("01T12", None, 1.0, 1) in emitted
    with pytest.raises(ValueError):
        windows.read_windows(spark, target, "fortnight", "sum")


def test_state_of_windows_stays_flat(spark, dirs):
    """Fifty batches of an hour each: state is that of the open windows, and Spark drops no more than what lands as late."""
    path, target = dirs("in"), dirs("out")
    rows = []
    for n in range(50):
        own = [event(10 * n + i, f"2024-01-{1 + n // 24:02d}T{n % 24:02d}:{10 * i:02d}", 1.0, f"t{i % 3}") for i in range(6)]
        if n % 10 == 9:
            own.append(event(10 * n + 9, f"2024-01-{1 + (n - 5) // 24:02d}T{(n - 5) % 24:02d}:30", 3.0))
        rows += own
        put(spark, path, own)
    query = windows.windowed_intervals(stream(spark, path), "hour", target, dirs("cp"), HOUR)
    query.awaitTermination()
    steps = progress(query)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in steps if p["stateOperators"]]
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in steps if p["stateOperators"])
    late = windows.read_late(spark, target).count()
    assert len(sizes) >= 50 and max(sizes) <= 3 * 4 and late == dropped == 5
    assert "RocksDB" in spark.conf.get(windows.STATE_STORE)
    got = windows.read_windows(spark, target, "hour", "count", with_late=True).agg(F.sum("n")).first()[0]
    still_open = [r for r in rows if r[5] >= "2024-01-03T00:00"]
    assert got == len(rows) - len(still_open)


@pytest.mark.parametrize("interval", ["10m", "30m", "day", "week", "month", "year"])
def test_intervals_from_windows(spark, dirs, interval):
    path, target = dirs("in"), dirs("out")
    put(spark, path, [event(i, f"2024-{1 + i % 3:02d}-{1 + i % 28:02d}T{i % 24:02d}:{i % 60:02d}", float(i)) for i in range(200)])
    put(spark, path, [event(999, "2030-01-01T00:00")])
    windows.windowed_intervals(stream(spark, path), interval, target, dirs("cp"), HOUR).awaitTermination()
    from tickloom.operators.timeseries import interval_aggregate

    rows = spark.read.schema(EVENT_SCHEMA).parquet(path).where("event_id < 999")
    for function in ("sum", "min", "max", "count"):
        got = windows.read_windows(spark, target, interval, function).select("name", "timestamp", "value", "n").collect()
        want = interval_aggregate(rows, interval, function, ["name"]).select("name", "timestamp", "value", "n").collect()
        assert sorted(got) == sorted(want), function


def run_rates(spark, path, target, checkpoint, **more):
    query = counters.state_counter_rates(stream(spark, path), target, checkpoint, **more)
    query.awaitTermination()
    return query


def rates(spark, target):
    return sorted((r.event_id, r.tag, r.value) for r in counters.read_state_rates(spark, target).collect())


def test_rates_become_final_in_order(spark, dirs):
    path, target, checkpoint = dirs("in"), dirs("out"), dirs("cp")
    put(spark, path, [event(1, "2024-01-01T00:00:00", 0.0), event(2, "2024-01-01T00:00:20", 200.0)])
    run_rates(spark, path, target, checkpoint, lateness=timedelta(seconds=30))
    assert rates(spark, target) == []
    # A reading between the two arrives, then one far enough ahead to make them final.
    put(spark, path, [event(3, "2024-01-01T00:00:10", 50.0), event(4, "2024-01-01T00:01:00", 100.0)])
    run_rates(spark, path, target, checkpoint, lateness=timedelta(seconds=30))
    assert rates(spark, target) == [(2, "t", 15.0), (3, "t", 5.0)]
    # Late: in front of what is final. It lands beside and changes nothing.
    put(spark, path, [event(5, "2024-01-01T00:00:15", 60.0), event(6, "2024-01-01T00:02:00", 700.0, tag=None)])
    run_rates(spark, path, target, checkpoint, lateness=timedelta(seconds=30))
    late = counters.read_late_readings(spark, target).collect()
    assert [(r.event_id, r.value, r.late_by_ms) for r in late] == [(5, 60.0, 15_000)]
    assert rates(spark, target) == [(2, "t", 15.0), (3, "t", 5.0), (4, "t", -2.0)]
    before = rates(spark, target)
    run_rates(spark, path, target, checkpoint, lateness=timedelta(seconds=30))
    assert rates(spark, target) == before
    with pytest.raises(ValueError):
        counters.state_counter_rates(stream(spark, path), target, checkpoint, on_reset="x")


def test_idle_counters_leave_the_state(spark, dirs):
    """A hundred counters that live for one batch each: state holds the last few, and a counter that returns begins anew."""
    path, target = dirs("in"), dirs("out")
    for n in range(50):
        when = f"2024-01-{1 + n // 24:02d}T{n % 24:02d}"
        put(spark, path, [event(10 * n + i, f"{when}:0{i}", float(100 * i), f"c{n}-{i % 2}") for i in range(4)])
    put(spark, path, [event(9000, "2024-01-05T00:00", 5.0, "c0-0")])
    query = run_rates(spark, path, target, dirs("cp"), lateness=timedelta(minutes=5), idle=HOUR)
    sizes = [p["stateOperators"][0]["customMetrics"].get("rocksdbNumInternalColFamiliesKeys", 0) + p["stateOperators"][0]["numRowsTotal"] for p in progress(query) if p["stateOperators"]]
    assert len(sizes) >= 50 and max(sizes[25:]) <= max(sizes[:25]) + 2
    found = rates(spark, target)
    assert len(found) == 100 and all(event_id < 9000 for event_id, _, _ in found)


def test_rates_equal_the_batch_operator(spark, dirs):
    """Resets, equal moments, null values and null tags, dealt out of order within the lateness."""
    path, target, checkpoint = dirs("in"), dirs("out"), dirs("cp")
    rows = []
    for i in range(300):
        minute = 5 + i - (i * 7) % 5
        value = None if i % 41 == 0 else float((i % 60) * 1000 + i % 7)
        tag = [None, "a", "b"][i % 3]
        rows.append((i, "n", value, tag, None, f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:{(i * 13) % 60 if i % 4 else 0:02d}"))
    for n in range(0, 300, 50):
        put(spark, path, rows[n : n + 50])
    put(spark, path, [event(9999, "2024-02-01T00:00", tag="end")])
    for on_reset in ("keep", "null"):
        own = f"{target}-{on_reset}"
        run_rates(spark, path, own, f"{checkpoint}-{on_reset}", lateness=timedelta(minutes=30), on_reset=on_reset)
        want = counter_rates(events(spark, rows), bounded=True, on_reset=on_reset).select("event_id", "tag", F.col("value").cast("double"))
        got = counters.read_state_rates(spark, own).select("event_id", "tag", "value")
        assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
        assert counters.read_late_readings(spark, own).count() == 0


def test_a_failed_batch_is_repeated(spark, dirs, monkeypatch):
    """A batch that fails after its rates were written lands them once when it is repeated."""
    path, target, checkpoint = dirs("in"), dirs("out"), dirs("cp")
    put(spark, path, [event(i, f"2024-01-01T00:00:{10 * i:02d}", 10.0 * i) for i in range(6)])
    put(spark, path, [event(9, "2024-01-02T00:00", 1.0)])
    real = counters.land

    def failing(rows, place, number):
        real(rows, place, number)
        if place.endswith("/late") and number == 1:
            raise RuntimeError("lost")

    monkeypatch.setattr(counters, "land", failing)
    with pytest.raises(Exception, match="lost"):
        run_rates(spark, path, target, checkpoint)
    monkeypatch.setattr(counters, "land", real)
    run_rates(spark, path, target, checkpoint)
    assert [e for e, _, _ in rates(spark, target)] == [1, 2, 3, 4, 5]
    assert landing.folders(spark, f"{target}/rates")[1][:2] == [0, 1]
