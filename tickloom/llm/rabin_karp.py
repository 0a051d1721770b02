"""Substring dedup over windows of words by Rabin-Karp hashes.

Every window of `width` words of every document has a rolling hash. A word goes
if it lies in a window whose words also start in a document with a smaller id;
overlapping windows merge into maximal removal intervals. All windows are
judged on the input.

Windows are counted together where they can be: those around one anchor whose
whole context is equal share one count (`repeats`). The windows whose anchor
has different contexts are hashed one by one and counted by Spark, so that what
is sent follows the text and not `width` times the text.

Words are `[^\\x20\\x09-\\x0D]+`, as they stand. Defined cases: a null text has
no words; a null doc_id comes after all other ids, and neither null nor equal
ids are smaller than each other; equal rows get equal results, one each; texts
with fewer words than a window lose nothing; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import free_shuffles, prepare, record, saved, text_buffers
from tickloom.llm.repeats import NO_ID, OPEN, SETTLED, Rolling, anchors, combined, keyed, match, merged, mixed, with_spans

WIDTH = 50
CACHED_WORDS = 400_000
SECOND = 0xC2B2AE3D27D4EB4F


class WordHashes:
    """64-bit hashes of words, remembered in a bounded cache."""

    def __init__(self, cached: int = CACHED_WORDS):
        self.cached = cached
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.known.get, words))
        if None in found:
            known, digest = self.known, xxhash.xxh3_64_intdigest
            for i, x in enumerate(found):
                if x is None:
                    if len(known) >= self.cached:
                        known.clear()
                    found[i] = known[words[i]] = digest(words[i])
        return np.array(found, np.uint64)


HASHES = WordHashes()


def words_of(batch: pa.RecordBatch) -> list[list[bytes]]:
    data, starts = text_buffers(batch.column("text"))
    raw = data.tobytes()
    return [raw[a:b].split() for a, b in zip(starts[:-1], starts[1:], strict=True)]


def hashed(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and where each document starts."""
    sizes = [len(x) for x in lists]
    symbols = np.concatenate([np.zeros(0, np.uint64), *(HASHES(x) for x in lists)])
    return symbols, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    doc = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    return doc.astype(np.int64), batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)


ROW = "h long, nh long, doc_id long, key long, lo int, hi int, sure boolean, twice boolean, several boolean"
ROW_SCHEMA = pa.schema(
    [("h", pa.int64()), ("nh", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]
    + [(x, pa.bool_()) for x in ("sure", "twice", "several")]
)


def anchor_batch(found: dict[str, np.ndarray], by_doc: bool) -> pa.RecordBatch:
    """Rows for `match`: the anchors that go on, and the spans settled already."""
    rows, twice, settled = combined(found, by_doc)
    on = ~settled
    key, lo, hi = merged(rows["key"][settled], rows["lo"][settled], rows["hi"][settled])
    flags = np.zeros(len(key), bool)
    both = lambda a, b: np.concatenate([a, b])
    return record(
        ROW_SCHEMA,
        both(rows["h"][on].view(np.int64), key),
        both(rows["nh"][on].view(np.int64), key),
        both(rows["doc_id"][on], np.zeros(len(key), np.int64)),
        both(rows["key"][on], key),
        both(rows["lo"][on], lo),
        both(rows["hi"][on], hi),
        both(np.zeros(on.sum(), bool), ~flags),
        both(twice[on], flags),
        np.zeros(on.sum() + len(key), bool),
    )


def _anchor_rows(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                symbols, starts = hashed(words_of(batch))
                found = anchors(lambda a, b, x=symbols: x[a:b], starts, width, k)
                doc, key = ids_of(batch)
                found["doc_id"], found["key"] = doc[found["doc"]], key[found["doc"]]
                yield anchor_batch(found, by_doc=True)

    return run


WINDOW = "h long, g long, doc_id long, key long, lo int"
WINDOW_SCHEMA = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("lo", pa.int32())])


def _window_rows(width: int):
    """Hashes of all windows within the open spans: two of 64 bits, over words hashed in two ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, key = ids_of(batch)
            los, his = batch.column("los").to_pylist(), batch.column("his").to_pylist()
            for i, words in enumerate(words_of(batch)):
                _, lo, hi = merged(np.zeros(len(los[i]), np.int64), np.array(los[i], np.int64), np.array(his[i], np.int64))
                at = np.concatenate([np.arange(a, b - width + 1) for a, b in zip(lo, hi, strict=True)])
                each = HASHES(words)
                h, g = (Rolling(x).hashes(at, at + width).view(np.int64) for x in (each, mixed(each ^ np.uint64(SECOND))))
                yield record(WINDOW_SCHEMA, h, g, np.full(len(at), doc[i]), np.full(len(at), key[i]), at)

    return run


def removal_spans(docs: DataFrame, width: int = WIDTH, k: int | None = None) -> DataFrame:
    """key, lo, hi: words of the document with that key to remove; spans may overlap."""
    spark = prepare(docs.sparkSession)
    k = k or max(1, (2 * width) // 3)
    found = keyed(docs).mapInArrow(_anchor_rows(width, k), ROW)
    told = saved(match(found, by_doc=True).select("state", "key", "lo", "hi"), "windows-anchors")
    free_shuffles(spark)
    open_ = told.filter(F.col("state").bitwiseAND(OPEN) != 0).select("key", "lo", "hi")
    windows = with_spans(docs, open_, "inner").select("doc_id", "text", "key", "los", "his")
    windows = saved(windows.mapInArrow(_window_rows(width), WINDOW), "windows-open")
    free_shuffles(spark)
    counted = windows.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    again = windows.join(counted, ["h", "g"]).filter("doc_id > first").select("key", "lo", (F.col("lo") + width).alias("hi"))
    settled = told.filter(F.col("state").bitwiseAND(SETTLED) != 0).select("key", "lo", "hi")
    return settled.unionByName(again)


def kept_places(n: int, los: list[int] | None, his: list[int] | None) -> tuple[np.ndarray, int]:
    """Which of n places stay, and how many maximal runs go."""
    if not los:
        return np.ones(n, bool), 0
    lo, hi = np.array(los, np.int64), np.array(his, np.int64)
    _, a, b = merged(np.zeros(len(lo), np.int64), lo, hi)
    edge = np.zeros(n + 1, np.int64)
    edge[a] += 1
    edge[b] -= 1
    return np.cumsum(edge[:n]) == 0, len(a)


def dedup_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def digest(words: list[bytes], los: list[int] | None, his: list[int] | None) -> tuple[int, int, str]:
        keep, _ = kept_places(len(words), los, his)
        kept = words if los is None else [words[i] for i in np.flatnonzero(keep)]
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return _finished(docs, width, schema, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_texts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and the words of its text that stay, joined by blanks."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def kept(words: list[bytes], los: list[int] | None, his: list[int] | None) -> tuple[bytes]:
        keep, _ = kept_places(len(words), los, his)
        return (b" ".join(words[i] for i in np.flatnonzero(keep)).decode(),)

    return _finished(docs, width, schema, kept, "doc_id long, text string")


def _finished(docs: DataFrame, width: int, schema: pa.Schema, result, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                los, his = batch.column("los").to_pylist(), batch.column("his").to_pylist()
                rows = [result(w, a, b) for w, a, b in zip(words_of(batch), los, his, strict=True)]
                yield record(schema, batch.column("doc_id").to_pylist(), *zip(*rows, strict=True))

    joined = with_spans(docs, removal_spans(docs, width), "left").select("doc_id", "text", "los", "his")
    return joined.mapInArrow(run, ddl)
