"""Kept partials and merged writes against the events themselves."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from helpers import events, plan
from pyspark.sql import functions as F

from tickloom.functions.aggregates import BUCKET_KINDS, SCALAR_KINDS, aggregate
from tickloom.operators import retrieve, rollup, tables
from tickloom.operators.retention import RetentionRule
from tickloom.operators.timeseries import interval_aggregate
from tickloom.plans.specs import SourceSpec
from tickloom.plans.view import run_view
from tickloom.sources import event_store, folders, merges, merging, rollups

NOW = datetime(2024, 1, 31)


def rows(n=400, start=0):
    """Ties in time, null tags and values, hours without events, several names."""
    out = []
    for i in range(start, start + n):
        when = datetime(2024, 1, 1) + timedelta(minutes=(i * 977) % 42_000 // 15 * 15)
        value = None if i % 29 == 0 else float((i * 13) % 101 - 50)
        out.append((i, ["a", "b", "x y", "50%/é+"][i % 4], value, [None, "s", "t"][i % 3], None, when.isoformat()))
    return out


def ids(spark, path):
    return sorted(r.event_id for r in event_store.read_events(spark, path).collect())


def rule(name, days):
    return RetentionRule.parse({"event_name": name, "max_age_days": days})


def test_partials_answer_every_aggregate(spark):
    frame = events(spark, rows())
    sums = rollup.partials(frame)
    for keys in (["name"], ["name", "tag"]):
        got = sums.groupBy(*keys).agg(*[rollup.merged(k).cast("string").alias(k) for k in SCALAR_KINDS]).collect()
        want = frame.groupBy(*keys).agg(*[aggregate(k).cast("string").alias(k) for k in SCALAR_KINDS]).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    for interval in rollup.INTERVALS:
        for function in BUCKET_KINDS:
            got = rollup.interval_values(sums, interval, function, ("name",)).collect()
            want = interval_aggregate(frame, interval, function, ["name"]).collect()
            assert sorted(map(repr, got)) == sorted(map(repr, want)), (interval, function)
    with pytest.raises(ValueError):
        rollup.interval_values(sums, "10m", "sum")
    with pytest.raises(ValueError):
        rollup.merged("median")


@pytest.mark.parametrize("age", [0, 1, 23.5, 29.1234])
def test_age_limits_between_hours(spark, age):
    frame = events(spark, rows())
    source = SourceSpec("s", "a", ("s", "t"), age)
    got = rollup.source_partials(rollup.partials(frame), frame, source, "a", NOW).agg(F.sum("n"), F.sum("total")).first()
    kept = retrieve.newer_than(retrieve.with_tags(retrieve.named(frame, "a"), ["s", "t"]), NOW, age)
    assert tuple(got) == tuple(kept.agg(F.when(F.count("*") > 0, F.count("*")), F.sum("value")).first())


VIEW = {
    "id": "v",
    "data": [{"id": "a", "event": "a"}, {"id": "b", "event": "b", "max_results": 5}],
    "widgets": [
        {"title": "c", "type": "counter", "data_sources": ["a"], "counter_type": "count"},
        {"title": "g", "type": "gauge", "data_sources": ["a"], "aggregation_type": "last", "show_last_value_time": True},
        {"title": "p", "type": "pie_chart", "data_sources": [{"id": "a", "tags": ["s"]}, "a"], "style": {"aggregation_type": "max"}},
        {"title": "l", "type": "line_graph", "data_sources": ["a"], "time_aggregation": {"starting_value": "day", "aggregation_function": "max"}},
        {"title": "d", "type": "line_graph", "data_sources": [{"id": "a", "mutators": [{"operation": "to_delta"}]}],
         "time_aggregation": {"starting_value": "day", "aggregation_function": "min"}},
        {"title": "short", "type": "line_graph", "data_sources": ["a"], "time_aggregation": {"starting_value": "10m"}},
        {"title": "limited", "type": "counter", "data_sources": ["b"], "counter_type": "count"},
        {"title": "t", "type": "table", "data_sources": ["b"], "table_columns": [{"title": "v", "event_field": "value"}]},
    ],
}


def test_views_from_partials_do_not_scan_events(spark, tmp_path):
    store, kept = str(tmp_path / "store"), str(tmp_path / "rollup")
    event_store.append_events(events(spark, rows()), store)
    assert rollups.refresh(spark, store, kept) > 0 and rollups.refresh(spark, store, kept) == 0
    frame = event_store.read_events(spark, store)
    direct = run_view(frame, VIEW, NOW)
    summed = run_view(frame, VIEW, NOW, kept=rollups.read_rollup(spark, store, kept))
    for title in direct.widgets:
        got, want = summed.widgets[title], direct.widgets[title]
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), title
        scans = plan(got).count(store)
        if title != "t":  # its rows are put in order and written when it is planned
            assert (scans == 0) == (title in ("c", "g", "p", "l", "d")), title


def test_partials_follow_the_table(spark, tmp_path):
    """Appends, retention, merging, and a name that is gone: only what changed is worked out."""
    store, kept = str(tmp_path / "store"), str(tmp_path / "rollup")

    def same():
        got = rollups.read_rollup(spark, store, kept).kept.groupBy("name").agg(F.sum("n").alias("n")).collect()
        want = event_store.read_events(spark, store).groupBy("name").agg(F.count("*").alias("n")).collect()
        return sorted(map(tuple, got)) == sorted(map(tuple, want))

    for part in range(3):
        event_store.append_events(events(spark, rows(40, 40 * part)), store, "month")
        assert rollups.refresh(spark, store, kept) == 4 and same()
    event_store.apply_retention(spark, store, [rule("a", 25), rule("b", 1)], NOW)
    assert not same()
    assert rollups.refresh(spark, store, kept) > 0 and same()
    merging.merge_writes(spark, store, at_least=2)
    names = event_store.read_events(spark, store).select("name").distinct().count()
    assert rollups.refresh(spark, store, kept) == names and same()
    assert rollups.refresh(spark, store, kept) == 0 and same()
    assert len(os.listdir(tmp_path / "rollup" / "marks")) <= 3


def test_merged_writes_keep_rows_and_ids(spark, tmp_path):
    store = str(tmp_path / "store")
    for part in range(12):
        event_store.append_events(events(spark, rows(20, 20 * part)), store, "month")
    frame = event_store.read_events(spark, store)
    before = sorted(map(repr, frame.collect()))
    assert folders.table_folders(spark, store).count() == 48
    assert len(merging.merge_writes(spark, store)) == 1
    assert folders.table_folders(spark, store).count() == 4
    assert sorted(map(repr, event_store.read_events(spark, store).collect())) == before
    assert merging.merge_writes(spark, store) == [] and merges.marks(spark, store) == merges.Marks()
    event_store.append_events(events(spark, rows(20, 500)), store, "month")
    assert ids(spark, store) == [*range(240), *range(500, 520)]
    assert event_store.apply_retention(spark, store, [rule("a", 0.001)], NOW) == {0: 65}
    assert all(i % 4 for i in ids(spark, store))


def test_many_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merging, "FOLDERS_A_MERGE", 4)
    store = str(tmp_path / "store")
    for part in range(4):
        event_store.append_events(events(spark, rows(8, 8 * part)), store, "month")
    assert len(merging.merge_writes(spark, store, 3)) > 1
    assert ids(spark, store) == list(range(32)) and folders.table_folders(spark, store).count() == 4


@pytest.mark.parametrize("at", ["replace_folders", "table_folders", "finished", "clear"])
def test_a_merge_cut_short_loses_nothing(spark, tmp_path, monkeypatch, at):
    """The run is lost before, while and after its rows come to count; readers and the next run see each event once."""
    store = str(tmp_path / "store")
    for part in range(4):
        event_store.append_events(events(spark, rows(20, 20 * part)), store, "month")
    real, calls = getattr(merging, at), []

    def lost(*args, **more):
        calls.append(at)
        if at == "replace_folders":
            real(*args, **more)
        if len(calls) == (1 if at in ("replace_folders", "finished") else 2):
            raise OSError("lost")
        return real(*args, **more)

    monkeypatch.setattr(merging, at, lost)
    with pytest.raises(OSError, match="lost"):
        merging.merge_writes(spark, store, 2)
    monkeypatch.setattr(merging, at, real)
    assert ids(spark, store) == list(range(80))
    event_store.append_events(events(spark, rows(20, 80)), store, "month")
    merging.merge_writes(spark, store, 2)
    assert ids(spark, store) == list(range(100)) and folders.table_folders(spark, store).count() == 4
    assert merges.marks(spark, store) == merges.Marks()


def test_what_changes_while_a_merge_runs(spark, tmp_path, monkeypatch):
    """An append and retention between the rows and the swap: the group retention touched stays, the others merge."""
    store = str(tmp_path / "store")
    for part in range(3):
        event_store.append_events(events(spark, rows(40, 40 * part)), store, "month")
    real = merging.replace_folders

    def meanwhile(*args, **more):
        real(*args, **more)
        event_store.append_events(events(spark, rows(4, 1000)), store, "month")
        event_store.apply_retention(spark, store, [rule("b", 0.001)], NOW)

    monkeypatch.setattr(merging, "replace_folders", meanwhile)
    merging.merge_writes(spark, store, 2)
    left = [i for i in [*range(120), *range(1000, 1004)] if i % 4 != 1]
    assert ids(spark, store) == left


def test_a_batch_repeated_after_its_write_was_merged(spark, tmp_path):
    store = str(tmp_path / "store")
    for part in range(3):
        event_store.append_events(events(spark, rows(8, 8 * part)), store, "month", owner=f"stream#{part}")
    merging.merge_writes(spark, store, 2)
    event_store.append_events(events(spark, rows(8, 16)), store, "month", owner="stream#2")
    assert ids(spark, store) == list(range(24))


def test_heavy_choices(spark):
    counted = [(f"v{i}", 600 // (i + 1)) for i in range(3000)]
    texts = [v for v, n in counted for _ in range(max(n, 1))] + ["", "tie1", "tie2"] * 40
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "event_id long, additional_info string").repartition(6)
    for k in (1, 5, 30, 4000):
        got = [r.choice for r in tables.heavy_choices(frame, "additional_info", k, tracked=16).collect()]
        assert got == [r.choice for r in tables.filter_choices(frame, "additional_info", k).collect()], k
    assert tables.heavy_choices(frame.limit(0), "additional_info", 3).count() == 0
    few = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "event_id long, additional_info string")
    assert [r.choice for r in tables.heavy_choices(few, "additional_info", 10).collect()] == ["a", "b"]
