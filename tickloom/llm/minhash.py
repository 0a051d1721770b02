"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document is the set of its distinct word shingles. The sketch has `BINS`
coordinates and is filled in rounds: in round i every shingle goes to one hashed
bin with a hashed value, and a bin keeps the smallest value of the first round
that reaches it. After `BINS` rounds, round BINS + j sends every shingle to bin
j, so every coordinate is filled. Coordinates of two sets agree with a
probability equal to their Jaccard similarity and, unlike those of one hashed
permutation, are concentrated as well as independent ones, at a cost near
n + BINS log BINS. One byte per coordinate is kept.

Eight coordinates are a band. Documents with an equal band are candidates; at a
similarity of 0.8 none of the 64 bands agrees once in 10^5 pairs. Sets that are
equal stand for each other, so copies are one candidate. Candidates whose
sketches agree too little to be linked (five standard deviations) are put
aside; all others that could still join two components are compared in full,
shingle by shingle, and never sent anywhere as pairs:

1. Every document is compared with the one that is smallest in most of its
   bands, which leaves few components in most bands.
2. Where a band still has several, a task looks at the sketches of its members
   and names those that have a candidate of another component; a pair counts in
   the first band it shares. Only these members get their texts, meet again by
   band, and a task compares them until no pair could join two components. What
   comes out are links, fewer than members.

Bands with many documents are cut into blocks. A component that fills a block
has blocks of its own, which do not meet each other, so what a large family
costs is given by the documents that are not linked to it yet.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a text with fewer words
than a shingle is one shingle. Defined cases: null, empty and blank texts have
no shingles and are linked with nothing; rows with a null doc_id are linked with
nothing, have a null component and are kept; rows with one doc_id and different
texts share a component, which is judged by the smallest of the texts; repeated
rows get equal results; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import free_shuffles, in_slices, prepare, record, saved, split_words, texts
from tickloom.llm.components import roots
from tickloom.llm.repeats import BASE, mixed

BINS = 512
BANDS = BINS // 8
SHINGLE = 4
PERCENT = 80
# A block holds so many units; a document is one, and another for so many shingles.
BLOCK = 1024
SHINGLES_A_UNIT = 1024
PAIRS_A_GROUP = 256


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts in a row, as sorted 64-bit hashes, and where
    those of each text begin (one more for the end)."""
    words, starts = split_words(pc.ascii_lower(column.fill_null("")))
    coded = words.dictionary_encode()
    each = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()] or [0], np.uint64)
    at = coded.indices.to_numpy(zero_copy_only=False)
    # Empty words stand at the ends of some texts.
    real = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[at] > 0 if len(at) else np.zeros(0, bool)
    one = each[at[real]]
    starts = np.concatenate([[0], np.cumsum(real)])[starts]
    counts = np.diff(starts)
    # One that is as long as the words there are, if these are fewer.
    used = np.minimum(counts, size)
    windows = np.where(counts > 0, counts - used + 1, 0)
    ends = np.concatenate([[0], np.cumsum(windows)])
    owner = np.repeat(np.arange(len(counts)), windows)
    first = starts[:-1][owner] + np.arange(ends[-1]) - ends[owner]
    h = used[owner].astype(np.uint64)
    for i in range(size):
        on = used[owner] > i
        h[on] = mixed(h[on] * np.uint64(BASE) + one[first[on] + i])
    sets = [np.unique(h[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One byte per coordinate and set; sets may not be empty."""
    n = len(sets)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n * bins, empty)
    if not n:
        return best.astype(np.uint8).reshape(0, bins)
    h = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    tag = (h >> np.uint64(17)) & np.uint64(0xFF)
    low = np.uint64(0xFF)
    shift = np.uint64(64 - (bins.bit_length() - 1))
    for i in range(2 * bins):
        x = mixed(h ^ np.uint64((i + 1) * BASE & (1 << 64) - 1))
        if i < bins:
            at = owner * bins + (x >> shift).astype(np.int64)
            x = (x << np.uint64(12)) & ~low | tag
        else:
            at = owner * bins + (i - bins)
            x = x & ~low | tag
        free = best[at] == empty
        np.minimum.at(best, at[free], np.minimum(x[free], empty - np.uint64(1)))
        left = (best.reshape(n, bins) == empty).any(axis=1)
        if not left.any():
            break
        if i < 8 or i % 8 == 0:
            on = left[owner]
            h, owner, tag = h[on], owner[on], tag[on]
    return (best & low).astype(np.uint8).reshape(n, bins)


def _sketch_rows(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("same", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_slices(whole)):
            all_of, starts = shingle_sets(batch.column("text"), size)
            sets = [all_of[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
            filled = [i for i, s in enumerate(sets) if len(s)]
            made = sketches([sets[i] for i in filled]).view("<i8")
            bands: list = [None] * len(sets)
            for i, row in zip(filled, made, strict=True):
                bands[i] = row
            same = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield record(schema, batch.column("doc_id"), [len(s) for s in sets], same, bands)

    return run


def least_agreement(percent: int, bins: int = BINS) -> int:
    """Equal coordinates below which a pair is not linked, five deviations out."""
    j = percent / 100
    return int(bins * j - 5 * (bins * j * (1 - j)) ** 0.5)


GROUP = ("band", "value", "first", "second")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one pair of blocks after the other, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in GROUP])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(keys[:, a].tolist())
            if last is not None and own != last:
                yield pa.Table.from_batches(held)
                held = []
            last = own
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


MEMBER = pa.schema([(c, pa.int64()) for c in ("band", "value", "first", "second", "block", "node", "root")])
MEMBER_DDL = "band long, value long, first long, second long, block long, node long, root long"


def _with_candidates(least: int):
    """Members of two blocks (or of one) that have a candidate: a member of another
    component whose sketch agrees in `least` coordinates, where no band before is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            band, first, second = (rows.column(c)[0].as_py() for c in ("band", "first", "second"))
            block, root = (rows.column(c).to_numpy() for c in ("block", "root"))
            long = rows.column("sketch").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
            sketch = np.ascontiguousarray(long).view(np.uint8).reshape(rows.num_rows, -1)
            left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
            found = np.zeros(rows.num_rows, bool)
            for n, i in enumerate(left):
                other = right[n + 1 :] if first == second else right
                other = other[root[other] != root[i]]
                if not len(other):
                    continue
                near = (sketch[other] == sketch[i]).sum(axis=1) >= least
                if band and near.any():
                    near[near] = ~(long[other[near], :band] == long[i, :band]).any(axis=1)
                if near.any():
                    found[i] = True
                    found[other[near]] = True
            if found.any():
                kept = rows.select(MEMBER.names).filter(pa.array(found))
                yield pa.RecordBatch.from_arrays([kept.column(c).combine_chunks().cast(pa.int64()) for c in MEMBER.names], schema=MEMBER)

    return run


class Joined:
    """Which members are known to be in one component."""

    def __init__(self, roots: np.ndarray):
        _, self.of = np.unique(roots, return_inverse=True)

    def join(self, i: int, others: np.ndarray) -> np.ndarray:
        """Links i with others, and returns those that it was not yet joined with, one for each component."""
        new = others[self.of[others] != self.of[i]]
        if len(new):
            components, at = np.unique(self.of[new], return_index=True)
            new = new[at]
            self.of[np.isin(self.of, components)] = self.of[i]
        return new


def incidence(all_of: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A bit for every member and every shingle that several members have."""
    _, at, counts = np.unique(all_of, return_inverse=True, return_counts=True)
    shared = counts > 1
    column = (np.cumsum(shared) - 1)[at]
    on = shared[at]
    words = np.zeros((n, max(1, -(-int(shared.sum()) // 64))), np.uint64)
    np.bitwise_or.at(words, (owner[on], column[on] >> 6), np.uint64(1) << (column[on] & 63).astype(np.uint64))
    return words


def _links_of_groups(size: int, percent: int):
    """Links between members of two blocks (or of one) with sets similar enough. A
    member is compared with those it is not joined with, by roots or by links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            first, second = (rows.column(c)[0].as_py() for c in ("first", "second"))
            block, node = (rows.column(c).to_numpy() for c in ("block", "node"))
            all_of, starts = shingle_sets(rows.column("text").combine_chunks(), size)
            sizes = np.diff(starts)
            bits = incidence(all_of, np.repeat(np.arange(len(node)), sizes), len(node))
            joined = Joined(rows.column("root").to_numpy())
            left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
            found: list[tuple[int, int]] = []
            for n, i in enumerate(left.tolist()):
                other = right[n + 1 :] if first == second else right
                other = other[joined.of[other] != joined.of[i]]
                if not len(other):
                    continue
                both = np.bitwise_count(bits[other] & bits[i]).sum(axis=1, dtype=np.int64)
                near = other[100 * both >= percent * (sizes[i] + sizes[other] - both)]
                found += [(i, j) for j in joined.join(i, near).tolist()]
            if found:
                a, b = node[np.array(found)].T
                yield record(schema, np.minimum(a, b), np.maximum(a, b))

    return run


def _verify(size: int, percent: int):
    """Rows sorted by (a, part, b), the first of each group being a itself."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_set = None, np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, part, b = (batch.column(c).to_pylist() for c in ("a", "part", "b"))
            linked: list[int] = []
            all_of, starts = shingle_sets(batch.column("text"), size)
            for i in range(batch.num_rows):
                found = all_of[starts[i] : starts[i + 1]]
                if b[i] is None:
                    own, own_set = (a[i], part[i]), found
                elif own == (a[i], part[i]):
                    both = len(np.intersect1d(own_set, found, assume_unique=True))
                    if 100 * both >= percent * (len(own_set) + len(found) - both):
                        linked.append(i)
            if linked:
                yield record(schema, [a[i] for i in linked], [b[i] for i in linked])

    return run


def links(pairs: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. bodies: node, text.

    The partners of a are dealt to groups of bounded size, each of which gets a's
    text once.
    """
    pairs = saved(pairs.select("a", "b").distinct(), "minhash-pairs")
    partners = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_GROUP).alias("parts"))
    dealt = pairs.join(partners, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).drop("parts")
    heads = dealt.select("a", "part").distinct().withColumn("b", F.lit(None).cast("long")).withColumn("node", F.col("a"))
    rows = dealt.withColumn("node", F.col("b")).unionByName(heads.select("a", "b", "part", "node"))
    rows = rows.join(bodies, "node").select("a", "part", "b", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return saved(rows.mapInArrow(_verify(size, percent), "a long, b long"), "minhash-links")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    spark = prepare(docs.sparkSession)
    rows = texts(docs)
    made = saved(rows.mapInArrow(_sketch_rows(size), "doc_id long, n_shingles long, same binary, sketch array<long>"), "minhash-sketches")
    known = made.filter("doc_id is not null and same is not null")
    # Equal sets: the smallest doc_id stands for all of them.
    first = [F.first(c).alias(c) for c in ("sketch", "n_shingles")]
    classes = known.groupBy("same").agg(F.min("doc_id").alias("node"), *first)
    classes = saved(classes, "minhash-classes")
    members = known.select("doc_id", "same").distinct().join(classes.select("same", "node"), "same")
    # What a member takes of a task's memory: its sketch, and its shingles when texts are compared.
    weight = (1 + F.floor(F.col("n_shingles") / SHINGLES_A_UNIT)).alias("weight")
    nodes = classes.select("node", weight, F.posexplode("sketch").alias("band", "value"))
    shared = nodes.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
    banded = nodes.join(shared, ["band", "value"])
    banded = saved(banded.select("band", "value", "node", "weight", "least"), "minhash-bands")
    free_shuffles(spark)
    # Texts of those with a partner, one per node.
    wanted = banded.select("node").distinct()
    first = rows.join(wanted, rows.doc_id == wanted.node).groupBy("node").agg(F.min("text").alias("text"))
    bodies = saved(first, "minhash-texts")
    free_shuffles(spark)
    bound = least_agreement(percent)
    sketch = classes.select("node", "sketch")

    # Of the documents that are smallest in a band of its own, the one with most of these bands.
    votes = banded.filter("node <> least").groupBy("node", "least").agg(F.count("*").alias("bands"))
    most = votes.groupBy("node").agg(F.max(F.struct("bands", (-F.col("least")).alias("less"))).alias("most"))
    star = most.select((-F.col("most.less")).alias("a"), F.col("node").alias("b"))
    agree = F.aggregate(F.zip_with("sa", "sb", _equal_bytes), F.lit(0), lambda x, y: x + y)
    star = star.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
    star = star.join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b").filter(agree >= bound)
    found = links(star.select("a", "b"), bodies, size, percent)
    same_id = members.filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    rows = _open_members(banded, sketch, roots(found))
    named = rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "node").mapInArrow(_with_candidates(bound), MEMBER_DDL)
    named = saved(named, "minhash-members").join(bodies, "node")
    linked = named.repartition(*GROUP).sortWithinPartitions(*GROUP, "node").mapInArrow(_links_of_groups(size, percent), "a long, b long")
    reached = roots(found.unionByName(linked).unionByName(same_id))
    named = made.join(reached.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def _equal_bytes(x, y):
    """How many of the eight bytes of two longs are equal."""
    bits = x.bitwiseXOR(y)
    for step in (4, 2, 1):  # bit 0 of a byte gathers all of its bits
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, step))
    return F.lit(8) - F.bit_count(bits.bitwiseAND(F.lit(0x0101010101010101))).cast("int")


def _open_members(banded: DataFrame, sketch: DataFrame, reached: DataFrame) -> DataFrame:
    """Members of the bands that still have several components, with their sketches,
    dealt to pairs of blocks of which each meets its own members and those of the other.

    Blocks are made of numbers alone; every member of one gets its sketch once, at the end.
    """
    rooted = banded.join(reached, "node", "left").select("band", "value", "node", "weight", F.coalesce("root", "node").alias("root"))
    rooted = saved(rooted, "minhash-rooted")
    keys = ["band", "value"]
    several = rooted.groupBy(*keys).agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select(*keys)
    members = saved(rooted.join(several, keys), "minhash-open")
    sums = members.groupBy(*keys, "root").agg(F.sum("weight").alias("own"))
    sums = saved(sums, "minhash-weights")
    pooled = F.sum(F.when(F.col("own") <= BLOCK, F.col("own")))
    large = sums.groupBy(*keys).agg(F.sum("own").alias("total"), pooled.alias("pooled")).filter(F.col("total") > BLOCK)
    large = large.select(*keys, F.ceil(F.coalesce("pooled", F.lit(0)) / BLOCK).alias("pools"))
    members = members.drop("weight")
    small = members.join(large, keys, "left_anti").withColumns({c: F.lit(0).cast("long") for c in ("first", "second", "block")})
    # A component that fills a block is dealt to blocks of its own by node, the others by root to blocks they share.
    dealt = members.join(large, keys).join(sums, [*keys, "root"])
    alone = F.col("own") > BLOCK
    of_root = F.xxhash64("root", F.pmod(F.xxhash64("node"), F.ceil(F.col("own") / BLOCK)))
    of_pool = F.pmod(F.xxhash64("root"), F.greatest("pools", F.lit(1)))
    dealt = dealt.withColumn("block", F.when(alone, of_root).otherwise(of_pool)).withColumn("alone", F.when(alone, F.col("root")))
    dealt = saved(dealt.select(*keys, "node", "root", "block", "alone"), "minhash-blocks")
    blocks = dealt.select(*keys, "block", "alone").distinct()
    other = blocks.select(*keys, F.col("block").alias("second"), F.col("alone").alias("other"))
    met = blocks.withColumnRenamed("block", "first").join(other, keys)
    met = met.filter((F.col("first") <= F.col("second")) & ~F.coalesce(F.col("alone") == F.col("other"), F.lit(False)))
    met = saved(met.select(*keys, "first", "second"), "minhash-met")
    own = dealt.drop("alone").withColumn("first", F.col("block")).join(met, [*keys, "first"])
    across = dealt.drop("alone").withColumn("second", F.col("block")).join(met.filter("first <> second"), [*keys, "second"])
    columns = [F.col(c).cast("long").alias(c) for c in MEMBER.names]
    placed = small.select(*columns).unionByName(own.select(*columns)).unionByName(across.select(*columns))
    return placed.join(sketch, "node").select(*MEMBER.names, "sketch")
