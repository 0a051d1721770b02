"""Helpers the operators share: sessions, scratch tables, Arrow text buffers."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.session import configure, stored

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Arrow batches end at the first of these two, so long texts come in few rows.
BATCH_ROWS = 4096
BATCH_BYTES = 8 << 20
SLICE_BYTES = 2 << 20
EVENTS_PASS_S = 0.6


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every operator counts on; workers find this package by path."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    known = spark.sparkContext.environment
    if ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known.get("PYTHONPATH")) if x)
    return spark


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends, executors may go,
    and the shuffle files that led to it are no longer needed."""
    table = stored(df, label)
    df.sparkSession._jvm.System.gc()
    return table


def free_shuffles(spark: SparkSession) -> None:
    """Let the cleaner drop the shuffle files of large steps that are done, which it
    does when the driver collects its garbage. What has just ended is still held
    by the events that tell of it, so there are two rounds with a pause."""
    for _ in range(2):
        time.sleep(EVENTS_PASS_S)
        spark.sparkContext._jvm.System.gc()


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and where each value starts (one
    more for the end). A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if not len(starts):
        starts = np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def in_slices(batch: pa.RecordBatch, size: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of a batch in stretches of about `size` bytes of text, for work whose
    arrays are many times as large as the text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and where those of each text begin (one more
    for the end). White space is blanks, tabs and line ends (bytes 9 to 13); a text
    that begins or ends with some has an empty word there."""
    lists = pc.ascii_split_whitespace(column.fill_null("") if column.null_count else column)
    starts = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), starts - starts[0]


class Vocabulary:
    """Numbers of the words met so far, which lie behind each other in one buffer."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.string())

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The number of each word, and the words that are new and got the next numbers."""
        coded = words.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.words)
        unknown = pc.is_null(at)
        new = coded.dictionary.filter(unknown)
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[unknown.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, new])
        return place[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64), new


def record(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def values_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(n).to_pylist() for n in names)


def crc_residue(column: str = "doc_id", modulus: int = 4):
    """crc32 of an id written as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
