"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order. The index posts every
vector under each of these pivots, with the place the pivot has in its order: a
pivot inverted file. A query reads the lists of its own nearest pivots and ranks
what it meets by Spearman's footrule, the sum of the differences of places (a
pivot missing on one side counts as the place behind the last). The best share
of each shard is compared by its true Euclidean distance.

The index is sharded by rows: every shard holds the inverted file of `shard`
distinct vectors, each with the ids that share it. A shard answers a block of
queries with its nearest `k`, and the answers of all shards are merged. The
share that is compared exactly is a share of the shard, so recall does not
depend on how many rows there are. Repeated vectors count once in a shard, with
their smallest ids, as only these can be among the nearest: ties go to the
smaller id.

Pivots are `pivots` vectors chosen by hash from a bounded sample of the table;
every row is indexed. Queries go out in blocks of `block`, the only data that
is sent to all tasks.

Defined cases: vectors that are null, zero, or hold a null or non-finite
component take no part, nor do rows with a null id; a query's own id is no
candidate; rows with an id already seen as query are answered once, for the
vector that is first in order; vectors of another length are no candidates;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tickloom.llm.common import prepare, record, saved

NEAREST = 10
PIVOTS = 512
ORDERED = 128
SHARE = 0.08
SHARD = 8192
BLOCK = 1024


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, v (array of double), dim of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size(v))


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """For each vector length, the distinct vectors with the smallest hashes."""
    first = Window.partitionBy("dim").orderBy("hash", "v")
    sampled = rows.groupBy("dim", F.xxhash64("v").alias("hash")).agg(F.min("v").alias("v"))
    found = sampled.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= pivots).collect()
    out: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r.dim, r["rank"])):
        out.setdefault(r.dim, []).append(r.v)
    return {dim: np.array(v) for dim, v in out.items()}


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, rounded; only good for choosing."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T


def permutations(v: np.ndarray, pivots: np.ndarray, ordered: int) -> np.ndarray:
    """The nearest pivots of each vector, in order."""
    d = squared(v, pivots)
    ordered = min(ordered, len(pivots))
    near = np.argpartition(d, ordered - 1, axis=1)[:, :ordered]
    return np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(axis=1, kind="stable"), 1)


class Shard:
    """Inverted files of some vectors of one length."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, pivots: np.ndarray, ordered: int, k: int):
        order = np.lexsort((ids, *v.T[::-1]))
        ids, v = ids[order], v[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]).any(axis=1)
        other = new.copy()
        other[1:] |= ids[1:] != ids[:-1]
        ids, v, new = ids[other], v[other], new[other]
        self.first = np.flatnonzero(new)
        # One more than k, as one of them can be the query itself.
        self.many = np.minimum(np.diff(np.append(self.first, len(v))), k + 1)
        self.ids, self.v, self.k = ids, v[self.first], k
        near = permutations(self.v, pivots, ordered)
        self.ordered = near.shape[1]
        place = np.broadcast_to(np.arange(self.ordered), near.shape)
        by_pivot = np.argsort(near.ravel(), kind="stable")
        self.posted = (by_pivot // self.ordered, place.ravel()[by_pivot])
        self.starts = np.searchsorted(near.ravel()[by_pivot], np.arange(len(pivots) + 1))

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Footrule distance of a query's pivots to those of every vector, less a constant."""
        m = self.ordered
        gain = np.zeros(len(self.v))
        for place, pivot in enumerate(query):
            rows, places = (x[self.starts[pivot] : self.starts[pivot + 1]] for x in self.posted)
            # Found on both sides: |a - b| instead of (m - a) + (m - b).
            gain[rows] -= (m - place) + (m - places) - np.abs(place - places)
        return gain

    def nearest(self, query_id: int, q: np.ndarray, near: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        far = self.footrule(near)
        budget = min(len(far), max(4 * (self.k + 1), int(np.ceil(share * len(far)))))
        chosen = np.argpartition(far, budget - 1)[:budget] if budget < len(far) else np.arange(len(far))
        d = np.sqrt(((self.v[chosen] - q) ** 2).sum(axis=1))
        best = chosen[np.argsort(d, kind="stable")]
        d = np.sort(d, kind="stable")
        if len(d) > self.k + 1:  # and whatever ties with the last of these
            last = np.searchsorted(d, d[self.k], "right")
            best, d = best[:last], d[:last]
        size = self.many[best]
        place = np.repeat(self.first[best] - np.cumsum(size) + size, size) + np.arange(size.sum())
        ids, d = self.ids[place], np.repeat(d, size)
        ids, d = ids[ids != query_id], d[ids != query_id]
        top = np.lexsort((ids, d))[: self.k]
        return ids[top], d[top]


def search(
    vectors: DataFrame, is_query: Column, k: int = NEAREST, id_column: str = "vec_id", vector_column: str = "embedding",
    pivots: int = PIVOTS, ordered: int = ORDERED, share: float = SHARE, shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row."""
    spark = prepare(vectors.sparkSession)
    rows = usable(vectors, id_column, vector_column)
    chosen = choose_pivots(rows, pivots)
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.*")
    numbered = queries.withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id())
    numbered = saved(numbered, "permutation-queries")
    at = Window.partitionBy("part").orderBy("n")
    numbered = numbered.withColumn("block", F.floor((F.row_number().over(at) - 1) / block))
    blocks = sorted((r.part, r.block) for r in numbered.select("part", "block").distinct().collect())
    index = spark.sparkContext.broadcast(chosen)
    answers = None
    for group in _together(blocks, numbered, block):
        sent = spark.sparkContext.broadcast(group)
        found = rows.mapInArrow(_answers(index, sent, k, ordered, share, shard), "query_id long, vec_id long, score double")
        found = saved(found, "permutation-answers")
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        return _empty(spark)
    best = answers.dropDuplicates(["query_id", "vec_id", "score"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _together(blocks: list, numbered: DataFrame, block: int) -> Iterator[list[tuple[int, list[float]]]]:
    """Queries, at most `block` at a time, gathered from one or several partitions."""
    held: list = []
    for part, number in blocks:
        here = numbered.filter((F.col("part") == part) & (F.col("block") == number)).select("vec_id", "v").collect()
        if held and len(held) + len(here) > block:
            yield held
            held = []
        held += [(r.vec_id, r.v) for r in here]
    if held:
        yield held


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _answers(index, sent, k: int, ordered: int, share: float, size: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def answer(ids: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        pivots = index.value[v.shape[1]]
        shard = Shard(ids, v, pivots, ordered, k)
        queries = [(i, q) for i, q in sent.value if len(q) == v.shape[1]]
        if not queries:
            return
        matrix = np.array([q for _, q in queries])
        found = [shard.nearest(i, q, near, share) for (i, _), q, near in zip(queries, matrix, permutations(matrix, pivots, ordered), strict=True)]
        sizes = [len(x) for x, _ in found]
        query = np.repeat([i for i, _ in queries], sizes)
        yield record(schema, query, np.concatenate([x for x, _ in found]), np.concatenate([d for _, d in found]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                part = held.setdefault(int(dim), [])
                part.append((ids[own], flat[starts[own][:, None] + np.arange(dim)]))
                if sum(len(i) for i, _ in part) >= size:
                    yield from answer(*(np.concatenate(x) for x in zip(*held.pop(int(dim)), strict=True)))
        for part in held.values():
            yield from answer(*(np.concatenate(x) for x in zip(*part, strict=True)))

    return run
