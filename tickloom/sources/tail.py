"""Growing text files read by byte offsets.

What was read of a file is kept as (file, bytes, head): how many bytes, which
end with a line, and the first `HEAD_BYTES` of them. The next read takes what
was added behind:

* A file that begins with its head and is at least as long has grown; whatever
  its modification time says, the bytes behind the offset are new.
* A file of another name that begins with the head of a file that no longer
  continues under its own name is that file, moved by a rotation; it is read on
  from the offset.
* Everything else is new and read from the front: new files, files that were
  cut, and what took the name of a rotated file.

An unfinished last line waits until it is finished, or is taken with
`whole_lines=false`. Large ranges are cut into pieces of `PIECE_BYTES`, and a
line belongs to the piece it begins in. Small ranges are read together by one
task, up to that size, where opening a file counts as `OPEN_BYTES`. Two files
with equal first `HEAD_BYTES` are told apart by their names only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from fnmatch import fnmatch
from typing import Any

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.session import stored
from tickloom.sources.logs import LogFormat, after_matches, first_matches, trimmed_lines
from tickloom.sources.spark_sources import PartitionedCollector, register_source
from tickloom.streaming.landing import BATCH, compact, folders, land, landed, newest_per_key

FORMAT = "tickloom_log_tail"
HEAD_BYTES = 256
PIECE_BYTES = 32 << 20
OPEN_BYTES = 1 << 20
BLOCK = 1 << 20
END_BYTES = 4 << 10
READERS = 16
BATCH_LINES = 20_000
OFFSETS_DDL = "file string, bytes long, head string"
STARTED_DDL = "file string, started boolean"
MERGED_AFTER = 50

# file -> [bytes, head in hex]
Offsets = dict[str, list]


def opened(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (files.LocalFileSystem(), path)


def _listing(path: str) -> tuple[files.FileSystem, list[files.FileInfo]]:
    """A file, the files of a folder, or those whose name fits a pattern; hidden ones are left out."""
    system, place = opened(path)
    folder, _, name = place.rstrip("/").rpartition("/")
    if any(c in name for c in "*?["):
        found = [x for x in system.get_file_info(files.FileSelector(folder, allow_not_found=True)) if fnmatch(x.base_name, name)]
    else:
        info = system.get_file_info(place.rstrip("/"))
        found = system.get_file_info(files.FileSelector(info.path)) if info.type == files.FileType.Directory else [info]
    return system, [x for x in found if x.type == files.FileType.File and x.base_name[:1] not in "._"]


def _last_line_end(source: pa.NativeFile, size: int) -> int:
    """Bytes up to the last line end. A line is looked for in little, then in more."""
    at, step = size, END_BYTES
    while at > 0:
        begin = max(0, at - step)
        source.seek(begin)
        found = source.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at, step = begin, min(2 * step, BLOCK)
    return 0


def reach(path: str, whole_lines: bool = True) -> Offsets:
    """How far the files reach now."""
    system, found = _listing(path)

    def one(info: files.FileInfo) -> list:
        with system.open_input_file(info.path) as source:
            size = source.size()
            end = _last_line_end(source, size) if whole_lines else size
            source.seek(0)
            return [end, source.read(min(end, HEAD_BYTES)).hex()]

    with ThreadPoolExecutor(READERS) as pool:
        return dict(zip([info.path for info in found], pool.map(one, found), strict=True))


def added(start: Offsets, end: Offsets) -> dict[str, tuple[int, int, str | None]]:
    """The byte range of each file that `start` does not cover, and the name the
    file had then (null if it is new)."""

    def continues(old: list, new: list) -> bool:
        return new[0] >= old[0] and new[1].startswith(old[1])

    begin: dict[str, tuple[int, str | None]] = {}
    moved: dict[str, list[tuple[int, str]]] = {}  # by head: offset and old name
    for file, old in start.items():
        if file in end and continues(old, end[file]):
            begin[file] = (old[0], file if old[0] else None)
        elif old[0]:
            moved.setdefault(old[1], []).append((old[0], file))
    lengths = sorted({len(head) for head in moved}, reverse=True)
    for file, new in sorted(end.items()):
        if file in begin:
            continue
        for n in lengths:  # the longest head it can have had
            fits = [x for x in moved.get(new[1][:n], ()) if x[0] <= new[0]] if len(new[1]) >= n else []
            if fits:
                begin[file] = max(fits)
                moved[new[1][:n]].remove(begin[file])
                break
    found = {file: (*begin.get(file, (0, None)), new[0]) for file, new in end.items()}
    return {file: (at, to, was) for file, (at, was, to) in found.items() if to > at}


class LogTail(PartitionedCollector):
    """Lines of growing files. Options: path, whole_lines (true), piece_bytes."""

    schema = "file string, was string, pos long, line string"
    _arrow = pa.schema([("file", pa.string()), ("was", pa.string()), ("pos", pa.int64()), ("line", pa.string())])

    def latest(self) -> Offsets:
        return reach(self._option("path"), self._option("whole_lines", "true") == "true")

    def _option(self, name: str, default: str | None = None) -> str:
        given = {k.lower(): v for k, v in self.options.items()}
        if name not in given and default is None:
            raise ValueError(f"option {name} is not given")
        return given.get(name, default)

    def partitions(self, start: Offsets, end: Offsets) -> list[dict[str, Any]]:
        step = int(self._option("piece_bytes", str(PIECE_BYTES)))
        out: list[dict[str, Any]] = []
        room = 0
        for file, (a, b, was) in sorted(added(start, end).items()):
            for at in range(a, b, step):
                piece = {"file": file, "was": was, "first": a, "from": at, "to": min(at + step, b), "end": b}
                cost = OPEN_BYTES + piece["to"] - at
                if not out or cost > room:
                    out.append({"pieces": []})
                    room = step
                out[-1]["pieces"].append(piece)
                room -= cost
        return out

    def read(self, part: Mapping[str, Any]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self._option("path"))
        for piece in part["pieces"]:
            yield from self._piece(system, piece)

    def _piece(self, system: files.FileSystem, part: Mapping[str, Any]) -> Iterator[pa.RecordBatch]:
        places, lines = [], []
        for at, line in _lines(system, part):
            places.append(at)
            lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
            if len(lines) == BATCH_LINES:
                yield self._batch(part, places, lines)
                places, lines = [], []
        if lines:
            yield self._batch(part, places, lines)

    def _batch(self, part: Mapping[str, Any], places: list[int], lines: list[str]) -> pa.RecordBatch:
        named = [pa.array([part[c]] * len(lines), pa.string()) for c in ("file", "was")]
        columns = [*named, pa.array(places, pa.int64()), pa.array(lines, pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema=self._arrow)


def _lines(system: files.FileSystem, part: Mapping[str, Any]) -> Iterator[tuple[int, bytes]]:
    """Lines that begin in a piece, with their place; the last may end behind it."""
    with system.open_input_file(part["file"]) as source:
        at, begins = part["from"], part["from"] == part["first"]
        if not begins:  # a line end right in front of the piece counts
            at -= 1
        source.seek(at)
        held = b""
        while True:
            block = source.read(min(BLOCK, part["end"] - at - len(held)))
            rows = (held + block).split(b"\n")
            held = rows.pop()
            for row in rows:
                if begins:
                    yield at, row
                begins = True
                at += len(row) + 1
                if at >= part["to"]:
                    return
            if not block:
                if held and begins:
                    yield at, held
                return


def tail_source(spark: SparkSession) -> str:
    """Registers the format and names it."""
    register_source(spark, FORMAT, LogTail)
    return FORMAT


def read_offsets(spark: SparkSession, path: str) -> tuple[int, Offsets]:
    """The number of the last read (-1 if there is none) and how far it went; a row per file."""
    numbers = folders(spark, path)[1]
    if not numbers:
        return -1, {}
    rows = spark.read.schema(OFFSETS_DDL).parquet(f"{path}/{BATCH}{numbers[-1]}").collect()
    return numbers[-1], {r.file: [r.bytes, r.head] for r in rows}


def write_offsets(spark: SparkSession, path: str, number: int, offsets: Offsets) -> None:
    """Keep the offsets of a read in a folder of its own; the one before stays, older ones go."""
    rows = [(file, size, head) for file, (size, head) in offsets.items()]
    land(spark.createDataFrame(rows, OFFSETS_DDL), path, number)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for old in folders(spark, path)[1][:-2]:
        system.delete(folder(f"{path}/{BATCH}{old}"), True)


def read_added(spark: SparkSession, path: str, since: Offsets, whole_lines: bool = True) -> tuple[DataFrame, Offsets]:
    """Lines (file, was, pos, line) that the offsets do not cover, and the offsets that do."""
    until = reach(path, whole_lines)
    reader = spark.read.format(tail_source(spark)).option("path", path).option("since", json.dumps(since))
    return reader.option("until", json.dumps(until)).load(), until


def tail_stream(spark: SparkSession, path: str, whole_lines: bool = True) -> DataFrame:
    """The same lines as a stream; its checkpoint holds the offsets."""
    return spark.readStream.format(tail_source(spark)).option("path", path).option("whole_lines", str(whole_lines).lower()).load()


def started_lines(lines: DataFrame, fmt: LogFormat, state: str, number: int) -> tuple[DataFrame, LogFormat]:
    """The lines of increment `number` that `skip_until` lets pass, and the format without it.

    Files of the increment are kept in `state` with whether they have had their
    match; what a repeated increment kept before does not count.
    """
    spark = lines.sparkSession
    known = newest_per_key(landed(spark, state, STARTED_DDL).where(F.col("batch_id") < number), ["file"]).where("started")
    lines = trimmed_lines(lines)
    matches = stored(first_matches(lines, fmt.skip_until, known), "matches")
    now = matches.select("file", (F.col("_seen") | F.col("_first").isNotNull()).alias("started"))
    land(now.groupBy("file").agg(F.max("started").alias("started")), state, number)
    if len(folders(spark, state)[1]) > MERGED_AFTER:
        compact(spark, state, STARTED_DDL, lambda rows: newest_per_key(rows, ["file"]))
    return after_matches(lines, matches), replace(fmt, skip_until=None)
