"""Files that grow, rotate and are cut, by offsets, in batch and as a data source."""

from __future__ import annotations

import os
from collections import Counter
from datetime import datetime

import pyarrow as pa
import pytest

from tickloom.sources import event_store, tail
from tickloom.sources.collectors import Collector, run_collectors
from tickloom.sources.spark_sources import PartitionedCollector, register_source
from tickloom.streaming import ingest

NOW = datetime(2025, 3, 1)
CONFIG = {"log_pattern": r"(\S+ \S+) (\w+) (.*)", "timestamp_format": "%Y-%m-%d %H:%M:%S"}


def line(n, text="text"):
    return f"2025-01-01 {n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d} info {text} {n}\n"


def log(folder, name, numbers, mode="a", text="text"):
    with open(folder / name, mode) as out:
        out.writelines(line(n, text) for n in numbers)


def test_what_is_new_in_each_file(tmp_path):
    seen = {}

    def step():
        nonlocal seen
        now = tail.reach(str(tmp_path))
        new = {os.path.basename(f): (a, b, was and os.path.basename(was)) for f, (a, b, was) in tail.added(seen, now).items()}
        seen = now
        return new

    assert step() == {}
    log(tmp_path, "a.log", range(100, 200))
    log(tmp_path, "b.log", range(100, 103))
    (tmp_path / ".hidden").write_text("x\n")
    (tmp_path / "empty.log").write_text("")
    assert step() == {"a.log": (0, 100 * len(line(100)), None), "b.log": (0, 3 * len(line(100)), None)}
    assert step() == {}
    # An unfinished line waits, an old modification time does not matter.
    log(tmp_path, "b.log", [103])
    with open(tmp_path / "b.log", "a") as out:
        out.write("unfinished")
    os.utime(tmp_path / "b.log", (1, 1))
    at = 3 * len(line(100))
    assert step() == {"b.log": (at, at + len(line(103)), "b.log")}
    # A rotation: the old file grew once more, the name begins anew.
    log(tmp_path, "a.log", [500])
    whole = os.path.getsize(tmp_path / "a.log")
    os.rename(tmp_path / "a.log", tmp_path / "a.log.1")
    log(tmp_path, "a.log", range(600, 900))
    assert step() == {"a.log.1": (whole - len(line(500)), whole, "a.log"), "a.log": (0, 300 * len(line(600)), None)}
    # Cut, and written again with other lines.
    log(tmp_path, "a.log", range(2000, 2002), "w")
    assert step() == {"a.log": (0, 2 * len(line(2000)), None)}
    os.remove(tmp_path / "a.log.1")
    assert step() == {}
    assert set(tail.reach(str(tmp_path / "*.log"))) == {str(tmp_path / f"{x}.log") for x in ("a", "b", "empty")}
    assert set(tail.reach(str(tmp_path / "b.log"))) == {str(tmp_path / "b.log")}
    assert tail.reach(str(tmp_path / "b.log"), whole_lines=False)[str(tmp_path / "b.log")][0] == os.path.getsize(tmp_path / "b.log")


@pytest.mark.parametrize("piece", [1, 7, 40, 1 << 20])
def test_pieces_cover_every_line_once(tmp_path, piece):
    body = b"".join(b"x" * (i * 7 % 90) + b"\r\n" * (i % 2) + b"\n" * (i % 2 == 0) for i in range(60)) + "ü".encode() * 30 + b"\n"
    (tmp_path / "f").write_bytes(body)
    collector = tail.LogTail({"path": str(tmp_path), "piece_bytes": str(piece)})
    got = [(r["pos"], r["line"]) for p in collector.partitions({}, collector.latest()) for b in collector.read(p) for r in b.to_pylist()]
    want, at = [], 0
    for row in body.split(b"\n")[:-1]:
        want.append((at, row.removesuffix(b"\r").decode()))
        at += len(row) + 1
    assert got == want


def test_batch_and_stream_give_equal_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(5):
        log(folder, f"{i}.log", range(i * 1000, i * 1000 + 200))
    name = tail.tail_source(spark)
    read = lambda: spark.read.format(name).option("path", str(folder)).option("piece_bytes", "2000").load()
    assert read().rdd.getNumPartitions() > 10
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = spark.readStream.format(name).option("path", str(folder)).option("piece_bytes", "2000").load()
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run()
    for i in range(5):
        log(folder, f"{i}.log", range(i * 1000 + 200, i * 1000 + 230))
    run()
    run()
    got = spark.read.parquet(target)
    assert sorted(got.select("file", "pos", "line").collect()) == sorted(read().select("file", "pos", "line").collect()) and got.count() == 1150
    assert got.where("was is not null").count() == 150


def squares():
    """A collector of its own, in a function so that it is sent to the workers whole: numbers up to a limit, and their squares."""

    class Squares(PartitionedCollector):
        schema = "n long, square long"

        def latest(self):
            return {"upto": int(self.options["limit"])}

        def start(self):
            return {"upto": 0}

        def partitions(self, start, end):
            return [{"from": a, "to": min(a + 10, end["upto"])} for a in range(start["upto"], end["upto"], 10)]

        def read(self, part):
            n = list(range(part["from"], part["to"]))
            yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64()), "square": pa.array([x * x for x in n], pa.int64())})

    return Squares


def test_a_registered_collector_is_a_format(spark, tmp_path):
    register_source(spark, "tickloom_squares", squares())
    read = spark.read.format("tickloom_squares").option("limit", 95).load()
    assert read.rdd.getNumPartitions() == 10 and sorted(tuple(r) for r in read.collect()) == [(n, n * n) for n in range(95)]
    assert spark.read.format("tickloom_squares").option("limit", 0).load().count() == 0
    stream = spark.readStream.format("tickloom_squares").option("limit", 95).load()
    seen: list = []

    def keep(batch, number):
        seen.append((number, sorted(r.n for r in batch.collect())))
        if len(seen) == 1:
            raise RuntimeError("lost")

    def run():
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert seen[0] == seen[1] == (0, list(range(95)))  # the failed batch again, from the same offsets


def messages(spark, store):
    return Counter(r.additional_info for r in event_store.read_events(spark, store).collect())


def test_collector_reads_each_byte_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    config = CONFIG | {"log_file_path": str(folder), "offsets_path": str(tmp_path / "offsets"), "as_of": NOW}
    collector = Collector.parse({"module": "logs_tail_collector", "config": config})
    paths = [str(tmp_path / x) for x in ("store", "cursors", "runs")]
    log(folder, "a.log", range(10))
    run_collectors(spark, [collector], *paths, NOW)
    # Lines older than the cursor, in a file that says it is old.
    log(folder, "b.log", range(5), text="old")
    os.utime(folder / "b.log", (1, 1))
    log(folder, "a.log", range(10, 15))
    run_collectors(spark, [collector], *paths, NOW)
    run_collectors(spark, [collector], *paths, NOW)
    assert messages(spark, paths[0]) == Counter([f"text {n}" for n in range(15)] + [f"old {n}" for n in range(5)])
    runs = sorted(r.n_events for r in spark.read.parquet(paths[2]).collect())
    assert runs == [0, 10, 10]
    with pytest.raises(ValueError, match="offsets_path"):
        Collector.parse({"module": "logs_tail_collector", "config": CONFIG | {"log_file_path": "x"}}).collect(spark, CONFIG | {"log_file_path": "x"}, None)


def test_an_increment_collected_again_replaces_itself(spark, tmp_path, monkeypatch):
    """The run is lost between the append and the commit of the offsets."""
    from tickloom.sources import collectors

    folder = tmp_path / "in"
    folder.mkdir()
    config = CONFIG | {"log_file_path": str(folder), "offsets_path": str(tmp_path / "offsets"), "as_of": NOW}
    collector = Collector.parse({"module": "logs_tail_collector", "config": config})
    paths = [str(tmp_path / x) for x in ("store", "cursors", "runs")]
    log(folder, "a.log", range(10))

    def lost(*_):
        raise OSError("gone")

    real = collectors.write_offsets
    monkeypatch.setattr(collectors, "write_offsets", lost)
    run_collectors(spark, [collector], *paths, NOW)
    monkeypatch.setattr(collectors, "write_offsets", real)
    log(folder, "a.log", range(10, 12))
    run_collectors(spark, [collector], *paths, NOW)
    assert messages(spark, paths[0]) == Counter(f"text {n}" for n in range(12))


def test_skip_until_over_increments(spark, tmp_path):
    """A match in a later batch, a rotation behind a match, and a name that begins anew."""
    folder = tmp_path / "in"
    folder.mkdir()
    store, checkpoint = str(tmp_path / "store"), str(tmp_path / "cp")

    def run():
        stream = tail.tail_stream(spark, str(folder))
        ingest.tail_logs(stream, CONFIG | {"skip_until": "begin"}, store, checkpoint, NOW).awaitTermination()
        return sorted(messages(spark, store))

    log(folder, "a.log", [1, 2], text="early")
    log(folder, "b.log", [3], text="never")
    assert run() == []
    log(folder, "a.log", [4], text="early")
    log(folder, "a.log", [5], text="begin")
    log(folder, "a.log", [6], text="after")
    assert run() == ["after 6", "begin 5"]
    log(folder, "a.log", [7], text="after")
    os.rename(folder / "a.log", folder / "a.log.1")
    log(folder, "a.log", [8, 9], text="anew")
    assert run() == ["after 6", "after 7", "begin 5"]
    log(folder, "a.log", [10], text="begin")
    log(folder, "a.log.1", [11], text="last")
    assert run() == ["after 6", "after 7", "begin 10", "begin 5", "last 11"]


def test_skip_until_on_whole_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = str(tmp_path / "store")
    for i in range(3):
        log(folder, f"{i}.log", [1, 2], text="early")
        log(folder, f"{i}.log", [3] if i else [], text="begin")
        log(folder, f"{i}.log", [4 + i], text="after")
    stream = ingest.text_stream(spark, str(folder), files_per_batch=1)
    ingest.tail_logs(stream, CONFIG | {"skip_until": "begin"}, store, str(tmp_path / "cp"), NOW).awaitTermination()
    assert sorted(messages(spark, store).elements()) == ["after 5", "after 6", "begin 3", "begin 3"]


def test_small_files_are_read_together(tmp_path, monkeypatch):
    """Tasks grow with the bytes, and not with the files; every line comes once, with its file and place."""
    monkeypatch.setattr(tail, "OPEN_BYTES", 100)
    want = []
    for n in range(60):
        lines = [f"{n} {i} " + "x" * (3000 if (n, i) == (7, 2) else 20) for i in range(5)]
        (tmp_path / f"{n:02}.log").write_text("".join(f"{line}\n" for line in lines))
        at = 0
        for line in lines:
            want.append((str(tmp_path / f"{n:02}.log"), at, line))
            at += len(line) + 1
    collector = tail.LogTail({"path": str(tmp_path), "piece_bytes": "2000"})
    parts = collector.partitions({}, collector.latest())
    got = [(r["file"], r["pos"], r["line"]) for p in parts for b in collector.read(p) for r in b.to_pylist()]
    assert got == want
    assert len(parts) <= 12


@pytest.mark.parametrize("size", [10, 5000, 3_000_000])
def test_last_line_end_is_found_from_behind(tmp_path, size):
    (tmp_path / "a.log").write_text("one\n" + "y" * size)
    (tmp_path / "b.log").write_text("y" * size)
    (tmp_path / "c.log").write_text("y" * size + "\n")
    assert [v[0] for _, v in sorted(tail.reach(str(tmp_path)).items())] == [4, 0, size + 1]
