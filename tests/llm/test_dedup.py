"""Substring, suffix-array and near-duplicate removal against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import compare
import numpy as np
import pytest

from tickloom.llm import components, minhash, queries, rabin_karp, repeats, suffix_array

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rows_of(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def made_up(seed=7):
    """Copies, near copies, shared passages, periodic and odd texts."""
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma,", "délta", "eps", "ζ", "eta.", "theta"] + [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passage, base = prose(70), prose(160)
    rows = [(1, prose(120)), (2, base), (3, base), (5, prose(30) + " " + passage + " " + prose(30)), (6, passage)]
    rows += [(7 + i, base.replace(f"w{i}", f"x{i}", 1)) for i in range(20, 60, 4)]
    rows += [(90, "same " * 300), (91, "same " * 120), (92, "ab" * 400), (93, "q" * 1000), (94, prose(3)), (95, prose(20) + " " + passage)]
    rows += [(96, None), (97, ""), (98, "  \n\t "), (None, passage + " tail of its own"), (99, prose(40) + "\n" + base[50:600] + "\x0b" + prose(20))]
    rows += [(100, base[:300] + prose(10) + base[300:]), (100, base[:300] + prose(10) + base[300:]), (101, "🙂é" * 150), (102, "x" + "🙂é" * 150)]
    rows += [(103, "A B C D E F"), (104, "a b c d e f"), (105, "a  b\tc"), (106, "A b C"), (None, passage)]
    return rows


def brute_bytes(rows, width):
    counts: dict[bytes, int] = {}
    bodies = [(t or "").encode() for _, t in rows]
    for b in bodies:
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            counts[w] = counts.get(w, 0) + 1
    out = []
    for (doc_id, _), b in zip(rows, bodies, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if counts[b[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((doc_id, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, width):
    first: dict[tuple, float] = {}
    lists = [WORD.findall((t or "").encode()) for _, t in rows]
    rank = lambda doc_id: float("inf") if doc_id is None else doc_id
    for (doc_id, _), words in zip(rows, lists, strict=True):
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            first[w] = min(first.get(w, float("inf")), rank(doc_id))
    out = []
    for (doc_id, _), words in zip(rows, lists, strict=True):
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < rank(doc_id):
                gone[i : i + width] = [True] * width
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def brute_near(rows, size, percent):
    sets = []
    for doc_id, text in rows:
        words = WORD.findall((text or "").encode().lower())
        grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        sets.append((doc_id, grams or ({tuple(words)} if words else set())))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return [(d, len(s), find(d), find(d) == d) for d, s in sets]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("width", [200, 37])
def test_bytes_against_brute_force(documents, width):
    rows = made_up()
    got = suffix_array.dedup_digests(documents(rows), width).collect()
    assert ordered(map(tuple, got)) == ordered(brute_bytes(rows, width))


@pytest.mark.parametrize("width", [50, 7])
def test_words_against_brute_force(documents, width):
    rows = made_up()
    got = rabin_karp.dedup_digests(documents(rows), width).collect()
    assert ordered(map(tuple, got)) == ordered(brute_words(rows, width))


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_against_brute_force(documents, size):
    rows = made_up()
    got = minhash.near_duplicates(documents(rows), size).collect()
    assert ordered(map(tuple, got)) == ordered(brute_near(rows, size, 80))


def test_op2_suffix_array(spark, sf_dir):
    got = queries.QUERIES["op2_suffix_array"](spark, sf_dir)
    assert ordered(map(tuple, got.collect())) == ordered(brute_bytes(rows_of(spark, sf_dir), 200))


def test_op6_rabin_karp(spark, sf_dir):
    got = queries.QUERIES["op6_rabin_karp"](spark, sf_dir)
    assert ordered(map(tuple, got.collect())) == ordered(brute_words(rows_of(spark, sf_dir), 50))


def test_op7_minhash(spark, sf_dir):
    got = queries.QUERIES["op7_minhash"](spark, sf_dir)
    assert ordered(map(tuple, got.collect())) == ordered(brute_near(rows_of(spark, sf_dir), 4, 80))


@pytest.mark.parametrize("name", ["op2_suffix_array", "op6_rabin_karp", "op7_minhash"])
def test_sql_states_the_same(name, sf_dir, spark):
    """The SQL twins against brute force; the queries are held against it above."""
    rows = rows_of(spark, sf_dir)
    brute = {"op2": lambda: brute_bytes(rows, 200), "op6": lambda: brute_words(rows, 50), "op7": lambda: brute_near(rows, 4, 80)}
    con = compare.connect(sf_dir)
    assert ordered(con.execute(queries.SQL[name]).fetchall()) == ordered(brute[name.split("_")[0]]())


def test_empty_tables(documents):
    none = documents([(1, "a")]).limit(0)
    assert suffix_array.dedup_digests(none).count() == 0
    assert rabin_karp.dedup_digests(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0


def test_texts_that_stay(documents):
    rows = [(1, "é" * 120 + "tail one"), (2, "é" * 120 + "another"), (3, None)]
    assert {r.doc_id: r.text for r in suffix_array.dedup_texts(documents(rows)).collect()} == {1: "tail one", 2: "another", 3: ""}
    rows = [(1, "a b c d"), (2, "x a b c y"), (3, "")]
    assert {r.doc_id: r.text for r in rabin_karp.dedup_texts(documents(rows), 3).collect()} == {1: "a b c d", 2: "x y", 3: ""}


def test_anchors_do_not_depend_on_blocks():
    data = np.random.default_rng(3).integers(0, 4, 9000).astype(np.uint8)
    data[4000:5000] = data[100:1100]
    data[6000:6500] = 1
    starts = np.array([0, 20, 20, 5000, 9000])
    symbols = lambda a, b: repeats.byte_symbols()[data[a:b]]
    whole = repeats.anchors(symbols, starts, 60, 30)
    small = repeats.anchors(symbols, starts, 60, 30, block=256)
    for name, values in whole.items():
        assert (values == small[name]).all(), name
    # Every window has an anchor, and its context holds the window.
    for doc in (2, 3):
        own = whole["doc"] == doc
        pos, lo, hi = (whole[x][own] for x in ("pos", "lo", "hi"))
        for at in range(int(starts[doc + 1] - starts[doc]) - 59):
            inside = (pos >= at) & (pos <= at + 30)
            assert inside.any() and (lo[inside] <= at).all() and (hi[inside] >= at + 60).all()


def test_matching_does_not_depend_on_batches(spark, documents):
    rows = documents([(i, f"{'common words in a row ' * 3} {i % 3} {'and the same end of it ' * 3}") for i in range(40)])
    whole = ordered(map(tuple, rabin_karp.dedup_digests(rows, 5).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    told = repeats.match(repeats.keyed(rows).mapInArrow(rabin_karp._anchor_rows(5, 3), rabin_karp.ROW), by_doc=True)
    assert told.filter("state % 2 = 1").count() > 0
    assert ordered(map(tuple, rabin_karp.dedup_digests(rows, 5).collect())) == whole


def test_sketches_agree_like_the_sets():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.8, 0.95):
        agree = []
        for _ in range(40):
            common = rng.integers(1, 1 << 62, int(400 * share)).astype(np.uint64)
            own = [rng.integers(1, 1 << 62, (400 - len(common)) // 2).astype(np.uint64) for _ in range(2)]
            x, y = minhash.sketches([np.unique(np.concatenate([common, o])) for o in own])
            agree.append((x == y).mean())
        assert abs(np.mean(agree) - (share + (1 - share) / 256)) < 0.01
        assert np.std(agree) < 1.3 * (share * (1 - share) / minhash.BINS) ** 0.5


def test_small_sets_fill_every_coordinate():
    two = repeats.mixed(np.array([5, 9], np.uint64))
    x, y, z = minhash.sketches([two[:1], two[:1], two])
    assert (x == y).all() and (x == x[0]).all() and 0.4 < (z == x).mean() < 0.6


def family(n, words=400, changed=7, seed=1):
    """Copies of one text, each with words of its own at a few places: similarities of 0.75 to 0.82."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(words), changed):
            own[at] = f"own{i}at{at}"
        rows.append((i, " ".join(own)))
    return rows


def test_families_send_rows_in_proportion(spark, documents, monkeypatch):
    """Members, links and pairs of the first step grow with the family and not with its pairs."""
    sent = {}
    real = minhash.saved

    def counted(df, label):
        table = real(df, label)
        if label in ("minhash-pairs", "minhash-members", "minhash-met"):
            sent[n] = sent.get(n, 0) + table.count()
        return table

    monkeypatch.setattr(minhash, "saved", counted)
    for n in (150, 300, 600):
        rows = family(n)
        got = minhash.near_duplicates(documents(rows)).collect()
        if n == 150:
            assert ordered(map(tuple, got)) == ordered(brute_near(rows, 4, 80))
    assert sent[600] < 6 * sent[150] and sent[600] < 600 * minhash.BANDS


def test_open_members_get_sketches_once(spark, documents, monkeypatch):
    """The sketches are read for one join, however blocks are made."""
    read, real = spark.sparkContext.accumulator(0), minhash._open_members
    classes = []

    def counted(banded, sketch, reached):
        def count(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        classes.append(sketch.count())
        return real(banded, sketch.mapInArrow(count, sketch.schema), reached)

    monkeypatch.setattr(minhash, "_open_members", counted)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = family(80, 200, 3, 2)
    assert ordered(map(tuple, minhash.near_duplicates(documents(rows)).collect())) == ordered(brute_near(rows, 4, 80))
    assert classes[0] > 0 and read.value == classes[0]


def test_small_blocks_give_the_same(documents, monkeypatch):
    """Bands cut into many blocks, with components that fill blocks of their own."""
    rows = [(2000 + i, t) for i, t in family(80, 200, 3, 2)] + [(1000 + i, t.replace("w1", "v1")) for i, t in family(40, 200, 3, 2)] + made_up()
    whole = ordered(map(tuple, minhash.near_duplicates(documents(rows)).collect()))
    assert whole == ordered(brute_near(rows, 4, 80))
    monkeypatch.setattr(minhash, "BLOCK", 8)
    assert ordered(map(tuple, minhash.near_duplicates(documents(rows)).collect())) == whole


def test_recall_at_the_threshold(documents):
    """Pairs whose similarity is 0.80 to 0.82 and that nothing else links."""
    rng = random.Random(9)
    rows = []
    for i in range(600):
        base = [f"p{i}w{j}" for j in range(300)]
        other = list(base)
        for at in rng.sample(range(3, 297), 8):
            other[at] = f"x{i}at{at}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    linked = {d for d, _, c, _ in brute_near(rows, 4, 80) if c != d}
    got = {r.doc_id for r in minhash.near_duplicates(documents(rows)).collect() if not r.kept}
    assert len(linked) > 200 and got <= linked and len(got) >= 0.99 * len(linked)


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (105, 101), (200, 200)]
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 105: 100}


def test_equal_bytes(spark):
    rng = np.random.default_rng(1)
    pairs = [tuple(int(v) for v in rng.integers(-(2**63), 2**63 - 1, 2)) for _ in range(50)]
    pairs += [(a, a ^ 0x00FF0000000000FF) for a, _ in pairs] + [(0, -1), (-1, -1), (0, 0), (-(2**63), 0)]
    frame = spark.createDataFrame(pairs, "x long, y long")
    from pyspark.sql import functions as F

    for x, y, n in frame.select("x", "y", minhash._equal_bytes(F.col("x"), F.col("y"))).collect():
        assert n == sum(a == b for a, b in zip(np.array([x]).tobytes(), np.array([y]).tobytes(), strict=True))
