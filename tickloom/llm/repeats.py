"""Finding equal windows of a fixed length across documents without sending every window.

Every window of `width` symbols picks an anchor: the k-gram in it whose hash is
smallest (all of them in a tie). Equal windows pick equal anchors, so whatever
repeats is found by comparing anchors. Around its anchor lies a context, the
stretch that all windows with this anchor can reach. Two occurrences of one
context share all their windows; these are settled at once. What is left are
anchors that occur in different contexts, and only their text is looked at
window by window, by the operators.

Symbols are 64-bit numbers: mixed bytes, or hashes of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
NO_ID = (1 << 63) - 1  # a null doc_id comes after all others

SETTLED, OPEN = 1, 2


def mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def byte_symbols() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    tables = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        power = np.full(n, base, np.uint64)
        power[0] = 1
        tables.append(np.multiply.accumulate(power))
    return tables[0], tables[1]


class Rolling:
    """Rabin-Karp hashes of any stretch of an array of symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        size = max(n + 1, BLOCK)
        up, self.down = _powers(1 << (size - 1).bit_length())
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * self.down[lo])

    def grams(self, k: int) -> np.ndarray:
        last = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:last]) * self.down[:last])


def _sliding(best, x: np.ndarray, width: int) -> np.ndarray:
    """best (minimum or maximum) over x[i : i + width] by doubling."""
    span = 1
    while span * 2 <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def cut(sizes: np.ndarray, width: int, block: int = BLOCK) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Stretches (document, from, to, first window, last window + 1), in lists of
    about `block` symbols. Long documents are cut with an overlap."""
    group, held = [], 0
    for doc, size in enumerate(sizes):
        if size < width:
            continue
        for at in range(0, size - width + 1, block):
            windows = min(at + block, size - width + 1)
            lo, hi = max(0, at - width), min(size, windows + 2 * width)
            group.append((doc, lo, hi, at, windows))
            held += hi - lo
            if held >= block:
                yield group
                group, held = [], 0
    if group:
        yield group


def anchors(symbols, starts: np.ndarray, width: int, k: int, block: int = BLOCK) -> dict[str, np.ndarray]:
    """Anchors of a batch: doc (its place in the batch), pos, lo and hi of the
    context in the document, h (hash of the k-gram), nh (of the context).

    symbols(a, b) gives the symbols of that stretch of the batch.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    w, reach = width - k + 1, width - k
    sizes = np.diff(starts)
    last_doc, last_pos = -1, -1
    for group in cut(sizes, width, block):
        s = np.array(group, np.int64)
        doc, lo, hi, w_from, w_to = s.T
        length = hi - lo
        base = np.concatenate([[0], np.cumsum(length)])
        flat = np.concatenate([symbols(starts[d] + a, starts[d] + b) for d, a, b, _, _ in group])
        n = len(flat)
        roll = Rolling(flat)
        h = roll.grams(k) | np.uint64(1)
        seg = np.repeat(np.arange(len(s)), length)
        at = np.arange(n) - base[seg] + lo[seg]  # place in the document
        crosses = at[: len(h)] + k > hi[seg[: len(h)]]
        h[crosses] = np.uint64(0xFFFFFFFFFFFFFFFF)
        if len(h) < w:
            continue
        least = _sliding(np.minimum, h, w)
        m = len(least)
        inside = (at[:m] >= w_from[seg[:m]]) & (at[:m] < w_to[seg[:m]])
        least[~inside] = 0
        edge = np.zeros(w - 1, np.uint64)
        chosen = _sliding(np.maximum, np.concatenate([edge, least, edge]), w)
        p = np.flatnonzero((chosen == h) & ~crosses)
        g, pos = seg[p], at[p]
        first = (doc[g] != last_doc) | (pos > last_pos)  # the block before had these already
        p, g, pos = p[first], g[first], pos[first]
        if not len(p):
            continue
        last_doc, last_pos = int(doc[g[-1]]), int(pos[-1])
        left = np.minimum(pos - np.maximum(pos - reach, 0), reach)
        right = np.minimum(pos + width, sizes[doc[g]]) - pos
        shape = (left * (width + 1) + right).astype(np.uint64) * np.uint64(BASE)
        parts.append((doc[g], pos, pos - left, pos + right, h[p], mixed(roll.hashes(p - left, p + right) + shape)))
    names = ("doc", "pos", "lo", "hi", "h", "nh")
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return {x: np.concatenate([q[i] for q in parts]) if parts else np.zeros(0, t) for i, (x, t) in enumerate(zip(names, kinds, strict=True))}


def merged(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the intervals of each key."""
    if not len(key):
        return key, lo, hi
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
    wide = int(hi.max()) + 1
    end = np.maximum.accumulate(hi + group * wide) - group * wide
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] > end[:-1])])
    first = np.flatnonzero(new)
    return key[first], lo[first], end[np.concatenate([first[1:] - 1, [len(key) - 1]])]


def combined(rows: dict[str, np.ndarray], by_doc: bool) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Settle what repeats within a batch before it is sent: which rows go on,
    whether their context was seen twice, and which rows are settled.

    With by_doc only an occurrence in a smaller document counts, otherwise any.
    """
    order = np.lexsort((rows["pos"], rows["doc_id"], rows["nh"], rows["h"]))
    rows = {k: v[order] for k, v in rows.items()}
    n = len(order)
    new = np.ones(n, bool)
    new[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["nh"][1:] != rows["nh"][:-1])
    if not n:
        return rows, new, new
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [n]]))
    if by_doc:
        settled = rows["doc_id"] > np.repeat(rows["doc_id"][first], size)
        return rows, np.zeros(n, bool), settled
    twice = np.repeat(size > 1, size)
    return rows, twice, twice & ~new


class Matcher:
    """Goes through rows sorted by (h, nh, doc_id), batch by batch, and tells
    which are settled and which are open. It keeps one context between batches:
    its first row, or with by_doc its rows of the smallest document."""

    def __init__(self, by_doc: bool):
        self.by_doc = by_doc
        self.kept: pa.Table | None = None

    def __call__(self, batch: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The rows that have a state, and the states."""
        table = pa.concat_tables([self.kept, batch]) if self.kept is not None else batch
        n = table.num_rows
        h, nh, doc = (table.column(c).to_numpy() for c in ("h", "nh", "doc_id"))
        twice = table.column("twice").to_numpy().astype(bool)
        several = table.column("several").to_numpy().astype(bool)
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new = new_h | np.concatenate([[True], nh[1:] != nh[:-1]])
        first, first_h = np.flatnonzero(new), np.flatnonzero(new_h)
        size, size_h = np.diff(np.append(first, n)), np.diff(np.append(first_h, n))
        least = np.repeat(doc[first], size)
        many = np.repeat((np.add.reduceat(new.astype(np.int64), first_h) > 1) | np.logical_or.reduceat(several, first_h), size_h)
        if self.by_doc:
            settled, head = doc > least, doc == least
        else:
            settled = np.repeat((size > 1) | np.logical_or.reduceat(twice, first), size)
            head = new
        state = np.where(settled, SETTLED, 0) + np.where(head & many, OPEN, 0)
        tail = np.flatnonzero(head & (np.arange(n) >= first[-1]))
        keep = table.take(pa.array(tail))
        flags = {"twice": settled[tail], "several": many[tail]}
        for name, values in flags.items():
            keep = keep.set_column(keep.schema.get_field_index(name), name, pa.array(values))
        self.kept = keep
        told = np.flatnonzero(state)
        return table.take(pa.array(told)), state[told]


def match(rows: DataFrame, by_doc: bool) -> DataFrame:
    """Send rows (h, nh, doc_id, key, lo, hi, sure, twice, several, ...) to their
    anchors and keep those with a state: SETTLED (their context repeats), OPEN
    (their anchor has other contexts), or both added. Rows that are sure pass."""
    schema = rows.schema
    out = "state int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(by_doc)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sure = table.column("sure").to_numpy().astype(bool)
            done = table.filter(pa.array(sure))
            found = [(done, np.full(done.num_rows, SETTLED))]
            rest = table.filter(pa.array(~sure))
            if rest.num_rows:
                found.append(matcher(rest))
            for part, state in found:
                if part.num_rows:
                    yield from part.add_column(0, "state", pa.array(state, pa.int32())).combine_chunks().to_batches()

    return rows.repartition("h").sortWithinPartitions("h", "nh", "doc_id", "key", "lo").mapInArrow(run, out)


def keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (null: empty) and a key: rows with one key are equal rows.
    Columns to keep get `kept_` in front."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    return docs.withColumn("key", F.xxhash64("doc_id", "text"))


def with_spans(docs: DataFrame, spans: DataFrame, how: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, key, the spans (lo, hi) of each key as arrays `los`, `his`, and
    the columns to keep.

    The spans of a document are bounded by its length. They are the side that
    is kept in memory, so the texts are sent once and not sorted.
    """
    per_key = spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    per_key = per_key.select("key", F.col("spans.lo").alias("los"), F.col("spans.hi").alias("his"))
    return keyed(docs, keep).join(per_key.hint("shuffle_hash"), "key", how)
