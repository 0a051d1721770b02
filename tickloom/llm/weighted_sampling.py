"""Document fingerprints by consistent weighted sampling.

The terms of a document are its words, weighted by how often they occur. For
each of `samples` hash functions every term draws r and c from Gamma(2, 1) and b
from U(0, 1), the same wherever the term occurs. With t = floor(ln w / r + b)
and ln y = r (t - b), the term with the smallest ln c - ln y - r is sampled
together with t. Two documents agree in a sample with a probability equal to
the generalised Jaccard similarity of their weights, sum(min) / sum(max).

A fingerprint is the samples' 16-bit hashes in hex, in order. Sampled values
only depend on words and counts, so equal texts have equal fingerprints.

The edited text of a document takes its second half from the next document in
descending doc_id order (the first one, after the last). Documents are dealt
out by ranges of doc_id, each with a copy of the head of the next range, so the
texts are shuffled once and read in order.

Words are `[^\\x20\\x09-\\x0D]+`, as they stand. Defined cases: a null text is
empty; a text without words has a fingerprint of zeros, which is like itself
and nothing else; null doc_ids come last in order; equal doc_ids are ordered by
a hash of their text and then by the text; a single document is its own next;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import prepare, record, texts
from tickloom.llm.repeats import mixed

SAMPLES = 64
CACHED_WORDS = 200_000
REPEATED_WORDS = 12_000
TOGETHER = 128  # words whose draws stay in a core's cache
RANGE_BYTES = 48 << 20
UNIT = np.float32(2.0**-23)
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


class Sampler:
    """Fingerprints of texts. Remembers, in bounded tables, what words draw that
    occur once in a text, and all draws of words that have occurred more often."""

    def __init__(self, samples: int = SAMPLES, cached: int = CACHED_WORDS, repeated: int = REPEATED_WORDS):
        self.samples, self.cached, self.repeated = samples, cached, repeated
        self.lanes = mixed(np.arange(1, 3 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(3, samples)
        self.lane = np.arange(samples)
        self.empty = "0" * (4 * samples)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.hashes = np.zeros(0, np.uint64)
        self.single = np.zeros((0, self.samples), np.float32)
        self.drawn_at = np.zeros(0, np.int64)
        self._forget()

    def _forget(self) -> None:
        self.drawn_at[:] = -1
        self.drawn, self.n_drawn = np.zeros((self.repeated, 3, self.samples), np.float32), 0

    def draws(self, hashes: np.ndarray) -> np.ndarray:
        """r, ln c and b of each word and sample, from the word's hash alone: two uniform
        draws of 23 bits from each of three hashes, of which five are used."""
        both = hashes[:, None, None] ^ self.lanes[None]
        both ^= both >> np.uint64(32)
        both *= MULTIPLIER
        both ^= both >> np.uint64(32)
        high = ((both >> np.uint64(41)).astype(np.float32) + np.float32(0.5)) * UNIT
        low = ((both & np.uint64(0x7FFFFF)).astype(np.float32) + np.float32(0.5)) * UNIT
        out = np.empty((len(hashes), 3, self.samples), np.float32)
        out[:, :2] = -np.log(high[:, :2] * low[:, :2])
        out[:, 1] = np.log(out[:, 1])
        out[:, 2] = high[:, 2]
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Remember new words with what they draw for a weight of one."""
        for a in range(0, len(words), TOGETHER):
            part = words[a : a + TOGETHER]
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in part], np.uint64)
            drawn = self.draws(hashes)
            at, last = len(self.known), len(self.known) + len(part)
            if len(self.single) < last:
                room = max(4096, len(self.single))
                self.single = np.concatenate([self.single, np.zeros((room, self.samples), np.float32)])
                self.hashes = np.concatenate([self.hashes, np.zeros(room, np.uint64)])
                self.drawn_at = np.concatenate([self.drawn_at, np.full(room, -1)])
            self.single[at:last] = value_of(drawn, np.float32(0))
            self.hashes[at:last] = hashes
            self.known.update(zip(part, range(at, last), strict=True))

    def _draws_of(self, places: np.ndarray) -> np.ndarray:
        """All draws of known words, at most `repeated` of them at a time."""
        new = places[self.drawn_at[places] < 0]
        if self.n_drawn + len(new) > self.repeated:
            self._forget()
            new = places
        if len(new):
            first, self.n_drawn = self.n_drawn, self.n_drawn + len(new)
            self.drawn_at[new] = np.arange(first, self.n_drawn)
            self.drawn[first : self.n_drawn] = self.draws(self.hashes[new])
        return self.drawn[self.drawn_at[places]]

    def __call__(self, text: str) -> str:
        counts = Counter(text.encode().split())
        if not counts:
            return self.empty
        new = [w for w in counts if w not in self.known]
        if new:
            if len(self.known) + len(new) > max(self.cached, len(counts)):
                self._clear()
                new = list(counts)
            self._learn(new)
        places = np.fromiter(map(self.known.__getitem__, counts), np.int64, len(counts))
        weight = np.fromiter(counts.values(), np.int64, len(counts))
        # Equal values go to the smaller hash, whatever order words came in.
        order = np.argsort(self.hashes[places])
        places, weight = places[order], weight[order]
        value = self.single[places]
        many = np.flatnonzero(weight > 1)
        steps = np.zeros((len(many), self.samples), np.float32)
        for a in range(0, len(many), self.repeated):
            part = many[a : a + self.repeated]
            drawn = self._draws_of(places[part])
            t = np.floor(np.log(weight[part].astype(np.float32))[:, None] / drawn[:, 0] + drawn[:, 2])
            value[part], steps[a : a + len(part)] = value_of(drawn, t), t
        best = value.argmin(axis=0)
        step = np.zeros(self.samples, np.uint64)
        if len(many):
            row = np.minimum(np.searchsorted(many, best), len(many) - 1)
            step = np.where(many[row] == best, steps[row, self.lane], 0).astype(np.uint64)
        sampled = mixed(self.hashes[places[best]] ^ mixed(step + np.uint64(1)))
        return (sampled >> np.uint64(48)).astype(">u2").tobytes().hex()


def value_of(drawn: np.ndarray, t: np.ndarray) -> np.ndarray:
    """ln c - ln y - r, where ln y = r (t - b)."""
    r, ln_c, b = drawn[:, 0], drawn[:, 1], drawn[:, 2]
    return ln_c - r * (t - b) - r


def likeness(a: str, b: str) -> float:
    """Share of equal samples."""
    x, y = (np.frombuffer(bytes.fromhex(v), ">u2") for v in (a, b))
    return float((x == y).mean()) if a.strip("0") and b.strip("0") else float(a == b)


SAMPLER: dict[int, Sampler] = {}


def sampler(samples: int) -> Sampler:
    if samples not in SAMPLER:
        SAMPLER[samples] = Sampler(samples)
    return SAMPLER[samples]


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, fingerprint of every text."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sampler(samples)
        for batch in batches:
            if batch.num_rows:
                yield record(schema, batch.column("doc_id"), [sample(t or "") for t in batch.column("text").to_pylist()])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def in_descending_order(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text, slot, guest: every slot is a range of doc_ids, largest first,
    sorted, and ends with the row that comes next in the whole order (guest).

    There are as many ranges as partitions, or more where the texts ask for it. Only
    their limits and one id per range are gathered. A task gets one range after the
    other, by number, so none is left without while another has several.
    """
    spark = docs.sparkSession
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    if ranges is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    # A null id comes after all others, so before them ascending.
    rows = rows.withColumn("rank", F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", F.xxhash64("text").alias("hash")))
    points = [i / ranges for i in range(1, ranges)]
    limits = sorted({int(x) for x in rows.approxQuantile("doc_id", points, 0.2 / ranges)}) if points else []
    # Slot 0 has the largest ids.
    above = F.lit(0)
    if limits:
        steps = F.array(*[F.lit(x).cast("long") for x in limits])
        above = F.when(F.col("doc_id").isNull(), F.lit(len(limits))).otherwise(F.size(F.filter(steps, lambda x: x > F.col("doc_id"))))
    rows = rows.withColumn("slot", above.cast("int"))
    heads = rows.groupBy("slot").agg(F.max("rank").alias("head")).orderBy("slot").collect()
    if not heads:
        return rows.select("doc_id", "text", "slot", F.lit(False).alias("guest"))
    # The head of each slot is a guest at the end of the slot before it.
    before = {h.slot: heads[i - 1].slot for i, h in enumerate(heads)}
    small = spark.createDataFrame(
        [(h.slot, h.head.doc_id, h.head.hash, before[h.slot]) for h in heads], "slot int, head_id long, head_hash long, at int"
    )
    # One row per slot, and one slot per partition: a side of known size.
    same = (rows.slot == small.slot) & rows.doc_id.eqNullSafe(small.head_id) & (rows["rank"]["hash"] == small.head_hash)
    guests = rows.join(F.broadcast(small), same).select(rows.doc_id, "text", F.col("at").alias("slot"), F.lit(True).alias("guest"))
    guests = guests.groupBy("slot", "doc_id", "guest").agg(F.max("text").alias("text")).select("doc_id", "text", "slot", "guest")
    own = rows.select("doc_id", "text", "slot", F.lit(False).alias("guest"))
    placed = own.unionByName(guests).repartitionByRange(len(heads), "slot")
    return placed.sortWithinPartitions("slot", "guest", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")), F.desc("text"))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next of every document and its edited text."""
    prepare(docs.sparkSession)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64())]
        + [(x, pa.string()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [(x, pa.float64()) for x in ("near_edited", "near_next")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sampler(samples)
        last = None  # slot, doc_id, text, fingerprint of the row whose next is awaited
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            columns = [batch.column(c).to_pylist() for c in ("slot", "doc_id", "text", "guest")]
            for slot, doc_id, text, guest in zip(*columns, strict=True):
                own = sample(text)
                if last is not None and last[0] == slot:
                    half = len(last[2]) // 2
                    edited = last[2][: len(last[2]) - half] + text[:half]
                    changed = sample(edited)
                    values = (last[1], len(last[2]), hashlib.sha256(edited.encode()).hexdigest(), last[3], changed)
                    for column, x in zip(out, (*values, likeness(last[3], changed), likeness(last[3], own)), strict=True):
                        column.append(x)
                last = None if guest else (slot, doc_id, text, own)
            if out[0]:
                yield record(schema, *out)

    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_descending_order(docs, ranges).mapInArrow(run, ddl)
