"""Dedup of byte strings with a distributed suffix array (difference cover).

A byte goes if it lies in a string of `width` bytes that also starts anywhere
else, in the same document too. The suffix array is only built where a repeat
can be, and over names instead of bytes:

1. Anchors (`repeats`) settle every stretch that occurs in one whole context
   more than once, and leave the stretches whose anchor has several contexts.
2. In these, every repeated k-gram of almost the full width gets a name, and
   the text around an occurrence becomes a short string: the `width - k` bytes
   on its left, the name, and the `width - k` bytes on its right. A string of
   `width` bytes with that k-gram is then `width - k + 1` symbols long.
3. Over these strings the difference cover algorithm runs as Spark jobs: sort
   the triples at places 1 and 2 modulo 3 by range and name them in order,
   recurse on triples of names (places three apart) until a name and its next
   symbols span the wanted prefix, bring in the suffixes at places 0 modulo 3
   by their first symbols and the name of the sampled suffix behind, sort them
   all by range, and compare the prefixes of neighbours in the order, across the
   borders of parts too. Triples that occur once end there: no other suffix
   shares that prefix.

No step depends on a group's size: names are one row per distinct triple, and
occurrences meet them in joins that adaptive execution splits.

Texts are UTF-8 bytes. Defined cases: a null text is empty; rows with a null or
repeated doc_id are documents of their own, and equal rows repeat each other;
texts under `width` bytes lose nothing; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import free_shuffles, prepare, record, saved, text_buffers
from tickloom.llm.rabin_karp import ROW, anchor_batch, kept_places
from tickloom.llm.repeats import OPEN, SETTLED, anchors, byte_symbols, combined, keyed, match, merged, with_spans

WIDTH = 200
# k-grams that are named, and how many symbols of a string lie on either side.
SIDE = 10
# Places of the sampled suffixes, modulo 3.
COVER = (1, 2)


def _anchor_rows(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_symbols()
        for batch in batches:
            if batch.num_rows:
                data, starts = text_buffers(batch.column("text"))
                found = anchors(lambda a, b, x=data: table[x[a:b]], starts, width, k)
                key = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
                found["key"], found["doc_id"] = key[found["doc"]], np.zeros(len(found["doc"]), np.int64)
                yield anchor_batch(found, by_doc=False)

    return run


GRAM = ROW + ", pos int, around binary"


def _gram_rows(width: int, side: int):
    """Anchors of almost the full width in the open stretches, with the bytes around them."""
    k = width - side
    schema = pa.schema(
        [("h", pa.int64()), ("nh", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]
        + [(x, pa.bool_()) for x in ("sure", "twice", "several")]
        + [("pos", pa.int32()), ("around", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_symbols()
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts = text_buffers(batch.column("text"))
            key = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(batch.column("los").value_lengths().to_numpy(zero_copy_only=False).cumsum(), prepend=0)
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            lo = batch.column("los").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            hi = batch.column("his").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc, lo, hi = merged(doc, lo, hi)
            # The open stretches, end to end, are the documents of this step.
            flat = np.concatenate([np.zeros(0, np.uint8), *(data[starts[d] + a : starts[d] + b] for d, a, b in zip(doc, lo, hi, strict=True))])
            parts = np.concatenate([[0], np.cumsum(hi - lo)])
            found = anchors(lambda a, b, x=flat: table[x[a:b]], parts, width, k)
            span = found["doc"]
            at = found["pos"] + parts[span]
            left, right = found["pos"] - found["lo"], found["hi"] - found["pos"] - k
            place = np.arange(-side, side)
            place = np.where(place < 0, place, place + k)
            spread = np.pad(flat, (side, width + side))[at[:, None] + side + place[None, :]] if len(at) else np.zeros((0, 2 * side), np.uint8)
            offset = lo[span]
            found |= {x: found[x] + offset for x in ("pos", "lo", "hi")}
            found["key"], found["doc_id"] = key[doc[span]], np.zeros(len(span), np.int64)
            found["around"], found["left"], found["right"] = spread, left, right
            rows, twice, settled = combined(found, by_doc=False)
            on = ~settled
            around = [x.tobytes() for x in rows["around"][on]]
            lone = np.zeros(on.sum(), bool)
            yield record(
                schema, rows["h"][on].view(np.int64), rows["nh"][on].view(np.int64), rows["doc_id"][on], rows["key"][on], rows["lo"][on],
                rows["hi"][on], lone, twice[on], lone, rows["pos"][on], around,
            )
            gone_key, gone_lo, gone_hi = merged(rows["key"][settled], rows["lo"][settled], rows["hi"][settled])
            no, yes, n = np.zeros(len(gone_key), bool), np.ones(len(gone_key), bool), len(gone_key)
            yield record(schema, gone_key, gone_key, np.zeros(n, np.int64), gone_key, gone_lo, gone_hi, yes, no, no, gone_lo, [b""] * n)

    return run


def _strings(side: int):
    """The string of each open k-gram: bytes, its name at place `side`, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("pos", pa.int32()), ("from", pa.int32()), ("to", pa.int32()), ("s", pa.list_(pa.int64()))])
        for batch in batches:
            if not batch.num_rows:
                continue
            around, _ = text_buffers(batch.column("around"))
            around = around.reshape(batch.num_rows, 2 * side).astype(np.int64)
            h = batch.column("h").to_numpy(zero_copy_only=False)[:, None]
            string = np.concatenate([around[:, :side], h, around[:, side:]], axis=1)
            pos, lo, hi = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "lo", "hi"))
            # First and last place at which a string of the full width starts in the stretch.
            yield record(schema, batch.column("key"), pos, side - (pos - lo), hi - pos, list(string))

    return run


def _named(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Rows whose values in `columns` occur more than once, with a name for them
    that follows their order."""
    repeated = rows.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    ordered = repeated.repartitionByRange(*columns).sortWithinPartitions(*columns)
    names = saved(ordered.withColumn("name", F.monotonically_increasing_id()), label)
    return rows.join(names, columns)


def _per_string(named: DataFrame, label: str) -> DataFrame:
    """Names of each string by place."""
    return saved(named.groupBy("key", "pos").agg(F.map_from_entries(F.collect_list(F.struct("at", "name"))).alias("names")), label)


def repeated_prefixes(strings: DataFrame, length: int) -> DataFrame:
    """key, pos, at: places of the strings `s` whose next `length` symbols occur at
    another place too, by the difference cover algorithm. Only places `from` to
    `to` count, and prefixes that end within their string."""
    s = F.col("s")
    size = F.size(s)
    strings = strings.select("key", "pos", "from", "to", "s")
    # Triples at the sampled places. Places are counted from 0, elements from 1.
    place = F.explode(F.filter(F.sequence(F.lit(0), size - 3), lambda i: (i % 3).isin(*COVER))).alias("at")
    triples = strings.select("key", "pos", "s", place).select("key", "pos", "at", *[F.element_at(s, F.col("at") + 1 + i).alias(f"t{i}") for i in range(3)])
    span = 3
    named = _named(triples, ["t0", "t1", "t2"], "suffix-names")
    # Recurse: triples of names, `span` places apart, as long as they stay short of the prefix.
    while True:
        names = _per_string(named.select("key", "pos", "at", "name"), "suffix-string")
        if span * 3 > length - 2:
            break
        step = span
        at = F.explode(F.map_keys("names")).alias("at")
        parts = [F.try_element_at("names", F.col("at") + step * i).alias(f"t{i}") for i in range(3)]
        longer = names.select("key", "pos", "names", at).select("key", "pos", "at", *parts).dropna()
        named = _named(longer, ["t0", "t1", "t2"], "suffix-names")
        span *= 3
    return _neighbours(strings.join(names, ["key", "pos"]), length, span)


def _neighbours(strings: DataFrame, length: int, span: int) -> DataFrame:
    """Order all suffixes by their first `length` symbols and keep those whose
    neighbour agrees.

    Sampled suffixes are ordered by their name and the symbols behind it; a
    suffix at a place 0 modulo 3 meets those at 1 by one symbol and the name
    behind it, and those at 2 by two. That makes three orders, which are one sort
    by range with the number of symbols in front of the name as its first column.
    Places come last in it, so a prefix that very many suffixes share is spread
    over parts; the rows at the borders of parts are compared across these.
    """
    spark = strings.sparkSession
    orders = {0: COVER, 1: (0, 1), 2: (0, 2)}  # symbols in front of the name: residues that meet
    beside = [f"e{i}" for i in range(length - span)]
    parts = []
    for front, residues in orders.items():
        before = [F.element_at("s", F.col("at") + 1 + i) for i in range(front)]
        behind = [F.element_at("s", F.col("at") + 1 + i) for i in range(front + span, length)]
        at = F.explode(F.filter(F.sequence(F.lit(0), F.size("s") - length), lambda i: (i % 3).isin(*residues))).alias("at")
        found = strings.select("key", "pos", "from", "to", "s", "names", at).filter("at between `from` and `to`")
        name = F.try_element_at("names", F.col("at") + front)
        symbols = [x.alias(c) for x, c in zip(before + behind, beside, strict=True)]
        parts.append(found.select(F.lit(front).alias("front"), name.alias("name"), *symbols, "key", "pos", "at"))
    suffixes = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("name is not null")
    suffixes = saved(suffixes, "suffix-unsorted")
    prefix = ["front", "name", *beside]
    order = [*prefix, "key", "pos", "at"]
    ranged = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in suffixes.schema)
    compared = saved(ranged.mapInArrow(_compared(prefix), f"{shape}, part int, agrees boolean, edge int"), "suffix-compared")
    # The last row of a part and the first of the next one.
    edges = compared.filter("edge > 0")
    numbers = sorted(r.part for r in edges.select("part").distinct().collect())
    follow = spark.createDataFrame(list(zip(numbers, numbers[1:], strict=False)), "part int, next int")
    place = ["key", "pos", "at"]
    last = edges.filter(F.col("edge").bitwiseAND(LAST) > 0).join(follow, "part").select("next", *prefix, F.struct(*place).alias("one"))
    first = edges.filter(F.col("edge").bitwiseAND(FIRST) > 0).select(F.col("part").alias("next"), *prefix, F.struct(*place).alias("other"))
    across = last.join(first, ["next", *prefix]).select(F.inline(F.array("one", "other")))
    return compared.filter("agrees").select(*place).unionByName(across)


FIRST, LAST = 1, 2


def _compared(prefix: list[str]):
    """Rows of a sorted part that agree with a neighbour in `prefix`, and its first and
    last row; one row is held back between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, begun, held_agrees = TaskContext.get().partitionId(), None, False, False

        def told(table: pa.Table, agrees: np.ndarray, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
            keep = np.flatnonzero(agrees | (edge > 0))
            if len(keep):
                rows = table.take(pa.array(keep))
                more = {"part": pa.array(np.full(len(keep), part), pa.int32()), "agrees": pa.array(agrees[keep]), "edge": pa.array(edge[keep], pa.int32())}
                for name, values in more.items():
                    rows = rows.append_column(name, values)
                yield from rows.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            n = table.num_rows
            keys = [table.column(c).to_numpy() for c in prefix]
            same = np.logical_and.reduce([k[1:] == k[:-1] for k in keys]) if n > 1 else np.zeros(0, bool)
            agrees = np.zeros(n, bool)
            agrees[:-1] |= same
            agrees[1:] |= same
            agrees[0] |= held_agrees
            edge = np.zeros(n, np.int32)
            if not begun:
                edge[0] = FIRST
            if n > 1:
                yield from told(table.slice(0, n - 1), agrees[:-1], edge[:-1])
                begun = True
            held, held_agrees, held_edge = table.slice(n - 1).combine_chunks(), bool(agrees[-1]), int(edge[-1])
        if held is not None:
            yield from told(held, np.array([held_agrees]), np.array([held_edge | LAST], np.int32))

    return run


def removal_spans(docs: DataFrame, width: int = WIDTH, k: int | None = None, side: int = SIDE) -> DataFrame:
    """key, lo, hi: bytes of the document with that key to remove; spans may overlap."""
    spark = prepare(docs.sparkSession)
    k, side = k or max(1, width // 2), max(4, min(side, width - 1))
    found = keyed(docs).mapInArrow(_anchor_rows(width, k), ROW)
    told = saved(match(found, by_doc=False).select("state", "key", "lo", "hi"), "suffix-anchors")
    free_shuffles(spark)
    has = lambda flag: F.col("state").bitwiseAND(flag) != 0
    open_ = told.filter(has(OPEN)).select("key", "lo", "hi")
    grams = with_spans(docs, open_, "inner").select("text", "key", "los", "his").mapInArrow(_gram_rows(width, side), GRAM)
    grams = saved(match(grams, by_doc=False).select("state", "h", "key", "lo", "hi", "pos", "around"), "suffix-grams")
    free_shuffles(spark)
    # Widths of the context beyond the k-gram, as places of the string.
    shown = grams.filter(has(OPEN)).dropDuplicates(["key", "pos"])
    strings = shown.mapInArrow(_strings(side), "key long, pos int, `from` int, `to` int, s array<long>")
    strings = saved(strings.withColumn("to", F.col("to") - (width - side)), "suffix-strings")
    again = repeated_prefixes(strings, side + 1)
    start = F.col("pos") - (side - F.col("at"))
    again = saved(again.select("key", start.cast("int").alias("lo"), (start + width).cast("int").alias("hi")), "suffix-repeats")
    free_shuffles(spark)
    settled = [x.filter(has(SETTLED)).select("key", "lo", "hi") for x in (told, grams)]
    return settled[0].unionByName(settled[1]).unionByName(again)


def dedup_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def digest(data: np.ndarray, los: list[int] | None, his: list[int] | None) -> tuple[int, int, int, str]:
        keep, n_spans = kept_places(len(data), los, his)
        kept = data[keep] if n_spans else data
        return len(data), len(data) - len(kept), n_spans, hashlib.sha256(kept.tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, found in _documents(batches):
            yield record(schema, doc_ids, *zip(*(digest(*x) for x in found), strict=True))

    return _joined(docs, width).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(docs: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the text that stays, and the columns `keep` with `kept_` in front.
    Characters that a span cuts in two go whole."""
    joined = _joined(docs, width, keep)
    out = joined.drop("los", "his").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in _documents([batch]):
                kept = [x[kept_places(len(x), a, b)[0]].tobytes().decode("utf-8", "ignore") for x, a, b in found]
                rest = batch.drop_columns(["los", "his"])
                yield rest.set_column(rest.schema.get_field_index("text"), "text", pa.array(kept, pa.string()))

    return joined.mapInArrow(run, out)


def _joined(docs: DataFrame, width: int, keep: tuple[str, ...] = ()) -> DataFrame:
    return with_spans(docs, removal_spans(docs, width), "left", keep).select("doc_id", "text", "los", "his", *[f"kept_{c}" for c in keep])


def _documents(batches) -> Iterator[tuple[list, list]]:
    for batch in batches:
        if batch.num_rows:
            data, starts = text_buffers(batch.column("text"))
            los, his = batch.column("los").to_pylist(), batch.column("his").to_pylist()
            yield batch.column("doc_id").to_pylist(), [(data[a:b], x, y) for a, b, x, y in zip(starts[:-1], starts[1:], los, his, strict=True)]
