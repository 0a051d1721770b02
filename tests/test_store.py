"""Event table, retention and collectors."""

from __future__ import annotations

import os
import re
from datetime import datetime, timedelta

import pytest
from helpers import at, events, plan, values
from pyspark.sql import functions as F

from catalog.base import user
from tickloom.model import normalize_events
from tickloom.operators import retention, retrieve, stats
from tickloom.operators.retention import RetentionRule
from tickloom.plans.view import run_view
from tickloom.sources import event_store
from tickloom.sources.collectors import Collector, read_cursor, run_collectors, run_retention

NOW = datetime(2024, 1, 31)


def rules(*configs):
    return [RetentionRule.parse(c) for c in configs]


def test_filter_on_name_prunes_folders(spark, sf_dir, tmp_path):
    path = str(tmp_path / "store")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    event_store.append_events(user(spark, sf_dir), path)
    frame = retrieve.named(event_store.read_events(spark, path, since=datetime(2024, 1, 20)), "user_error")
    scan = next(line for line in plan(frame).splitlines() if "FileScan" in line)
    assert re.search(r"PartitionFilters: \[[^]]*name#\d+ = user_error", scan)
    assert re.search(r"PartitionFilters: \[[^]]*period#\d+ >= 2024-01-01", scan)
    assert "GreaterThanOrEqual(timestamp" in scan
    assert frame.count() == user(spark, sf_dir).where("name = 'user_error' and timestamp >= '2024-01-20'").count()
    with pytest.raises(ValueError):
        event_store.append_events(user(spark, sf_dir), path, period="hour")


def test_views_open_only_periods_within_the_age(spark, sf_dir, tmp_path):
    path = str(tmp_path / "store")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    event_store.append_events(user(spark, sf_dir), path)
    page = {
        "id": "v",
        "data": [{"id": "clicks", "event": "user_click", "max_age_days": 30}],
        "widgets": [{"type": "counter", "title": "c", "data_sources": ["clicks"], "counter_type": "count"}],
    }
    frame = event_store.read_events(spark, path, keep_period=True)
    counted = run_view(frame, page, datetime(2024, 2, 20)).widgets["c"]
    scan = next(line for line in plan(counted).splitlines() if "FileScan" in line)
    assert re.search(r"PartitionFilters: \[[^]]*period#\d+ >= 2024-01-01", scan)
    assert counted.first().value == user(spark, sf_dir).where("name = 'user_click' and timestamp >= '2024-01-21'").count()
    ranged = retrieve.between(frame, datetime(2024, 1, 5), datetime(2024, 1, 9))
    assert ranged.count() == user(spark, sf_dir).where("timestamp >= '2024-01-05' and timestamp < '2024-01-09'").count()


def test_every_write_has_ids_of_its_own(spark, tmp_path):
    path = str(tmp_path / "store")
    for _ in range(2):
        event_store.append_event(spark, path, "one", NOW)
        event_store.append_events(spark.range(70_000).select(*event_columns()), path, new_ids=True)
    ids = [r.event_id for r in event_store.read_events(spark, path).select("event_id").collect()]
    assert len(set(ids)) == len(ids) == 140_002 and min(ids) > 0
    with pytest.raises(ValueError):
        event_store.append_event(spark, path, "", NOW)


def event_columns():
    stamp = F.lit(at("2024-01-01")).alias("timestamp")
    nothing = F.lit(None).cast("string")
    return [F.lit(None).cast("long").alias("event_id"), F.lit("n").alias("name"), F.lit(1.0).alias("value"), nothing.alias("tag"), nothing.alias("additional_info"), stamp]


def test_a_repeated_write_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "store")
    first = event_store.append_events(events(spark, STORED), path, new_ids=True, owner="s#1")
    event_store.append_events(events(spark, STORED), path, new_ids=True, owner="s#2")
    assert event_store.append_events(events(spark, STORED), path, new_ids=True, owner="s#1") == first
    assert event_store.read_events(spark, path).count() == 2 * len(STORED)
    assert event_store.read_events(spark, path).select("event_id").distinct().count() == 2 * len(STORED)


def test_too_many_rows_for_an_id_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(event_store, "ROW_BITS", 3)
    with pytest.raises(Exception, match="repartition"):
        spark.range(100, numPartitions=1).select(event_store.numbered(1)).collect()


def test_appends_during_retention_survive(spark, tmp_path, monkeypatch):
    """Events that arrive between the decision and the replacement are kept."""
    path = str(tmp_path / "store")
    event_store.append_events(events(spark, STORED), path)
    replace, late = event_store.replace_folders, [(9, "x y", 9.0, "a", None, "2024-01-01T00:00:00")]

    def replace_later(rows, where):
        monkeypatch.setattr(event_store, "replace_folders", replace)
        event_store.append_events(events(spark, late), path)
        replace(rows, where)

    monkeypatch.setattr(event_store, "replace_folders", replace_later)
    event_store.apply_retention(spark, path, rules({"event_name": "x y", "max_age_days": 7}), NOW)
    assert sorted(r.event_id for r in event_store.read_events(spark, path).collect()) == [3, 5, 9]


def test_many_rules(spark, tmp_path):
    path = str(tmp_path / "store")
    event_store.append_events(events(spark, STORED), path)
    many = rules(*({"event_name": f"n{i}", "max_age_days": 1} for i in range(3000)), {"event_name": "z", "max_age_days": 1})
    assert sum(event_store.apply_retention(spark, path, many, NOW).values()) == 1


def test_append_one_event(spark, tmp_path):
    path = str(tmp_path / "store")
    event_store.append_event(spark, path, "a b/c=d", NOW)
    event_store.append_event(spark, path, "a b/c=d", NOW, 2.5, "t", "i", datetime(2024, 1, 2, 3))
    frame = event_store.read_events(spark, path)
    got = values(frame, "name", "value", "tag", "additional_info", F.unix_micros("timestamp"))
    day = round(at("2024-01-31").timestamp()) * 1_000_000
    early = round(at("2024-01-02T03:00:00").timestamp()) * 1_000_000
    assert sorted(got, key=repr) == [("a b/c=d", 0.0, None, None, day), ("a b/c=d", 2.5, "t", "i", early)]


def folders(path):
    return sorted(
        os.path.relpath(root, path) for root, _, files in os.walk(path) if any(f.endswith(".parquet") for f in files)
    )


STORED = [
    (1, "x y", 1.0, "a", None, "2024-01-01T00:00:00"),
    (2, "x y", 2.0, "b", None, "2024-01-01T00:00:00"),
    (3, "x y", 3.0, "a", None, "2024-01-24T00:00:00"),
    (4, "x y", 4.0, None, None, "2024-01-23T23:59:59.999999"),
    (5, "z", 5.0, "a", None, "2024-01-01T00:00:00"),
]


def test_retention_touches_only_what_expired(spark, tmp_path):
    path = str(tmp_path / "store")
    event_store.append_events(events(spark, STORED), path)
    before = {f: sorted(os.listdir(os.path.join(path, f))) for f in folders(path)}
    week = rules({"event_name": "x y", "tag": "a", "max_age_days": 7}, {"event_name": "z", "max_age_days": 1})
    assert event_store.apply_retention(spark, path, week, NOW) == {0: 1, 1: 1}
    assert sorted(r.event_id for r in event_store.read_events(spark, path).collect()) == [2, 3, 4]
    after = {f: sorted(os.listdir(os.path.join(path, f))) for f in folders(path)}
    changed = {f for f in before if before[f] != after.get(f)}
    assert changed == {"name=x y/period=2024-01-01/write=1", "name=z/period=2024-01-01/write=1"}
    # The border moment itself stays, one microsecond earlier goes.
    event_store.apply_retention(spark, path, rules({"event_name": "x y", "max_age_days": 7}), NOW)
    assert [r.event_id for r in event_store.read_events(spark, path).collect()] == [3]
    event_store.apply_retention(spark, path, rules({"event_name": "none", "max_age_days": 7}), NOW)
    assert event_store.read_events(spark, path).count() == 1


def test_retention_copy_leaves_the_old_table(spark, tmp_path):
    path, target = str(tmp_path / "old"), str(tmp_path / "new")
    event_store.append_events(events(spark, STORED), path, "month")
    event_store.copy_retained(spark, path, target, rules({"event_name": "x y", "max_age_days": 7}), NOW, "month")
    assert event_store.read_events(spark, path).count() == 5
    assert sorted(r.event_id for r in event_store.read_events(spark, target).collect()) == [3, 5]


def test_kept_and_deleted_make_up_the_input(spark, sf_dir):
    frame = user(spark, sf_dir)
    some = rules({"event_name": "user_click", "max_age_days": 9}, {"event_name": "user_click", "tag": "1", "max_age_days": 2})
    deleted = retention.deleted_counts(frame, some, NOW).agg(F.sum("deleted")).first()[0]
    assert retention.retained(frame, some, NOW).count() + deleted == frame.count()


def test_rule_checks():
    for broken in ({"event_name": "x"}, {"max_age_days": 1}, {"event_name": "x", "retention_days": 3}):
        with pytest.raises(ValueError):
            RetentionRule.parse(broken)
    assert RetentionRule.parse({"event_name": "x", "max_age_days": 1, "tag": ""}).tag is None


def test_no_rules_keep_everything(spark):
    assert retention.retained(events(spark, STORED), [], NOW).count() == 5


def test_collectors_fail_alone_and_resume(spark, tmp_path):
    store, cursors, log = (str(tmp_path / p) for p in ("store", "cursors", "log"))
    source = events(spark, [(i, "n" if i % 3 else None, float(i), None, None, f"2024-01-0{i}") for i in range(1, 8)])
    until = [datetime(2024, 1, 4)]
    seen = []

    def collect(spark, config, cursor):
        seen.append(cursor)
        ready = source.where(F.col("timestamp") <= F.lit(at(until[0].isoformat())))
        return ready if cursor is None else ready.where(F.col("timestamp") > F.lit(cursor))

    def broken(spark, config, cursor):
        raise RuntimeError(config["why"])

    collectors = [
        Collector("bad", broken, {"why": "no reason"}),
        Collector("good", collect, unique_id="one", retention=lambda c: [{"event_name": "n", "max_age_days": 3}]),
    ]
    run_collectors(spark, collectors, store, cursors, log, NOW)
    until[0] = datetime(2024, 1, 7)
    run_collectors(spark, collectors, store, cursors, log, NOW + timedelta(minutes=1))
    run_collectors(spark, collectors, store, cursors, log, NOW + timedelta(minutes=2))
    stored = event_store.read_events(spark, store).collect()
    assert sorted(r.value for r in stored) == [1, 2, 4, 5, 7] and len({r.event_id for r in stored}) == 5
    assert seen[0] is None and [s.day for s in seen[1:]] == [4, 7]
    assert read_cursor(spark, cursors, "bad_") is None
    assert collectors[1].retention_rules() == rules({"event_name": "n", "max_age_days": 3})
    assert collectors[0].retention_rules() == []
    assert [r.rejected for r in spark.read.parquet(log).where("module = 'good'").orderBy("started").collect()] == [1, 1, 0]
    table = {r.module: r for r in stats.run_stats(spark.read.parquet(log)).collect()}
    assert (table["bad"].runs_count, table["bad"].errors_count, table["bad"].collected_events) == (3, 3, 0)
    assert table["bad"].error_message == "RuntimeError: no reason"
    assert (table["good"].runs_count, table["good"].errors_count, table["good"].collected_events) == (3, 0, 5)
    assert table["good"].avg_execution_time_ms > 0 and table["good"].error_message == ""


def test_retention_of_collectors(spark, tmp_path):
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    event_store.append_events(events(spark, STORED), store)

    def nothing(spark, config, cursor):
        return events(spark, [])

    collectors = [
        Collector("xy", nothing, {"days": 7}, retention=lambda c: [{"event_name": "x y", "max_age_days": c["days"]}]),
        Collector("rest", nothing, retention=lambda c: [{"event_name": n, "max_age_days": 1} for n in ("x y", "z")]),
        Collector("none", nothing),
    ]
    assert run_retention(spark, collectors, store, log, NOW) == {"xy_": 3, "rest_": 2, "none_": 0}
    table = {r.module: r for r in stats.run_stats(spark.read.parquet(log)).collect()}
    assert [(table[m].runs_count, table[m].cleanup_times, table[m].deleted_events_count) for m in ("xy", "rest", "none")] == [
        (0, 1, 3),
        (0, 1, 2),
        (0, 1, 0),
    ]
    bad = Collector("bad", nothing, retention=lambda c: [{"event_name": "x y"}])
    with pytest.raises(ValueError):
        run_retention(spark, [*collectors, bad], store, log, NOW)


def test_configured_log_collector(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "app.log").write_text("INFO 2024-01-02 03:04:05 hello\nERROR 2024-01-02 03:04:06 again\n")
    entry = {
        "module": "logs_collector",
        "unique_id": "app",
        "collect_interval_in_minutes": 5,
        "config": {
            "log_file_path": str(folder),
            "log_pattern": r"(\w+) (\S+ \S+) (.*)",
            "timestamp_format": "%Y-%m-%d %H:%M:%S",
            "severity_group_index": 1,
            "timestamp_group_index": 2,
            "retention_days": 60,
        },
    }
    collector = Collector.parse(entry)
    assert collector.interval_minutes == 5
    assert collector.retention_rules() == rules({"event_name": "log_message", "max_age_days": 60})
    kept = Collector.parse(entry | {"config": {k: v for k, v in entry["config"].items() if k != "retention_days"}})
    assert kept.retention_rules() == []
    paths = [str(tmp_path / p) for p in ("store", "cursors", "log")]
    for minute in (0, 3, 6):
        run_collectors(spark, [collector], *paths, NOW + timedelta(minutes=minute))
    assert spark.read.parquet(paths[2]).count() == 2  # three minutes in it was not due
    got = values(event_store.read_events(spark, paths[0]).orderBy("timestamp"), "tag", "additional_info", "value")
    assert got == [("INFO", "hello", 1.0), ("ERROR", "again", 1.0)]
    with pytest.raises(ValueError):
        Collector.parse({"module": "unheard of"})


def test_when_collectors_are_due():
    def due(last=None, started=None, **config):
        collector = Collector("m", None, interval_minutes=config.get("minutes"), at_start=config.get("at_start", False))
        return collector.due(NOW, last, started)

    assert due() and due(last=NOW)
    assert due(minutes=5) and not due(minutes=5, started=NOW) and due(minutes=5, started=NOW - timedelta(minutes=5))
    assert due(minutes=5, started=NOW, at_start=True)
    assert not due(minutes=5, last=NOW - timedelta(minutes=4), at_start=True) and due(minutes=5, last=NOW - timedelta(minutes=5))


def test_faults_that_are_not_the_source_stop_the_run(spark, tmp_path):
    def starved(spark, config, cursor):
        raise MemoryError

    with pytest.raises(MemoryError):
        run_collectors(spark, [Collector("m", starved)], *(str(tmp_path / p) for p in "abc"), NOW)


def test_request_log(spark, tmp_path):
    log = str(tmp_path / "requests")
    for n in (1, 2):
        with stats.recorded_request(spark, log, "latest", max_results=n, tags=None):
            pass
    with pytest.raises(KeyError), stats.recorded_request(spark, log, "latest", max_results=1):
        raise KeyError("x")
    got = {r.api_name: (r.total_calls, r.total_errors) for r in stats.query_stats(spark.read.parquet(log)).collect()}
    assert got == {"name=latest;max_results=1": (2, 1), "name=latest;max_results=2": (1, 0)}


def test_records_keep_microseconds(spark, tmp_path):
    frame = normalize_events(events(spark, STORED), {c: c for c in events(spark, []).columns}, NOW)
    path = str(tmp_path / "out")
    event_store.export_records(frame, path)
    back = event_store.read_records(spark, path, frame.schema)
    assert sorted(back.collect(), key=repr) == sorted(frame.collect(), key=repr)
