"""Archives, the prefix trie and whitening against brute force."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest

from tickloom.llm import prefix_trie, queries, warc, whitening

PAGES = "page_id long, url string, html string, size long, digest string, first string"
TURNS = "conv_id long, turn long, role string, text string, part string, depth int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], PAGES)


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)


@pytest.mark.parametrize("name", ["op11_warc", "op12_prefix_trie"])
def test_query_matches_sql(spark, sf_dir, name):
    got = compare.spark_table(queries.QUERIES[name](spark, sf_dir))
    assert compare.difference(got, compare.sql_table(compare.connect(sf_dir), queries.SQL[name])) is None


def brute_pages(rows):
    first = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= warc.SHARED_BYTES and page_id is not None:
            first[body] = min(first.get(body, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        there = first.get(body)
        revisit = there is not None and there != page_id
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", there if revisit else None))
    return sorted(out, key=repr)


def page_rows():
    body = "<p>shared</p>" * 40
    rows = [(i, f"http://h.example/{i}?q=1#top", body) for i in (9, 4, 30, 31)]
    rows += [(4, "http://h.example/4?q=1#top", body), (None, None, body), (None, "no scheme\r\nWARC-Type: x", "x"), (50, "", None), (51, "a", "")]
    rows += [(52, "u", "same small"), (53, "u", "same small"), (54, "https://é.example", "é" * 60), (55, "u", "é" * 60), (56, "u", "é" * 49)]
    rows += [(60, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\n\r\n"), (61, "u", "\r\n\r\n" * 50), (62, "u", "\x00\x1f\x8b\x00" * 30)]
    return rows + [(70, "u", "long " * 400_000), (71, "u", "long " * 400_000), (72, "u", "\n")]


def test_archives_of_odd_pages(spark):
    rows = page_rows()
    got = warc.round_trip(pages(spark, rows))
    assert got.columns == ["row_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    found = got.select("row_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_pages(rows)
    assert warc.round_trip(pages(spark, rows).limit(0)).count() == 0


def test_captures_are_nested(spark, tmp_path):
    rows = page_rows()
    warc.write_archives(pages(spark, rows), str(tmp_path / "w"), compression="none")
    captures = warc.read_captures(spark, str(tmp_path / "w"), payloads=True).collect()
    assert len(captures) == len(rows)
    bodies = Counter((r[0], (r[2] or "").encode()) for r in rows)
    for c in captures:
        assert len(c.requests) == len(c.metadata) == 1 and c.response.record_id == c.capture_id
        assert c.requests[0].first_line.startswith("GET /") and "#" not in c.requests[0].first_line
        fields = c.metadata[0].fields
        row_id = int(fields["row-id"]) if fields["row-id"] else None
        if c.response.kind == "response":
            assert bodies[row_id, bytes(c.response.payload)]
            assert c.response.stated_digest == "sha256:" + c.response.payload_sha256
            assert int(c.response.fields["content-length"]) == c.response.payload_bytes == int(fields["payload-bytes"])
        else:
            assert c.response.payload_bytes == 0 and int(fields["payload-bytes"]) >= warc.SHARED_BYTES


def written(kind, own, block, *headers, content="application/http; msgtype=response"):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"Content-Type: {content}", *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Records of one member each, named through another record, orphans, and an archive cut short."""
    http = b"HTTP/1.1 404 Not Found\r\nX-A: 1\r\n more\r\nx-a: 2\r\n\r\nbody"
    first = [
        written("warcinfo", "<i>", b"software: x\r\n", content="application/warc-fields"),
        written("response", "<a>", http, "WARC-Target-URI: http://a/"),
        written("request", "<b>", b"GET / HTTP/1.0\r\n\r\n", "WARC-Concurrent-To: <a>", content="application/http; msgtype=request"),
        written("metadata", "<c>", b"k: v\r\nk2: w\r\n", "warc-concurrent-to: <b>", content="application/warc-fields"),
        written("metadata", "<d>", b"z: 1\r\n", "WARC-Concurrent-To: <a>", content="application/warc-fields"),
    ]
    second = [
        written("response", "<r>", http, "WARC-Concurrent-To: <q>", "WARC-Concurrent-To: <q2>"),
        written("request", "<q>", b"GET /q HTTP/1.0\r\n\r\n", content="application/http; msgtype=request"),
        written("metadata", "<m>", b"a: b\r\n", "WARC-Concurrent-To: <gone>", content="application/warc-fields"),
        written("request", "<n>", b"GET /n HTTP/1.0\r\n\r\n", "WARC-Concurrent-To: <gone>", content="application/http; msgtype=request"),
        written("revisit", "<v>", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Payload-Digest: sha256:" + "0" * 64),
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in first))
    (tmp_path / "two.warc").write_bytes(b"".join(second) + written("response", "<cut>", b"x" * 100)[:-50])
    (tmp_path / "empty.warc").write_bytes(b"")
    captures = {c.capture_id: c for c in warc.read_captures(spark, str(tmp_path), payloads=True).collect()}
    assert set(captures) == {"<a>", "<r>", "<gone>", "<v>"}
    assert [r.record_id for r in captures["<a>"].requests] == ["<b>"]
    assert [r.record_id for r in captures["<a>"].metadata] == ["<c>", "<d>"] and captures["<a>"].metadata[0].fields == {"k": "v", "k2": "w"}
    assert captures["<a>"].response.first_line == "HTTP/1.1 404 Not Found" and captures["<a>"].response.fields == {"x-a": "2"}
    assert bytes(captures["<a>"].response.payload) == b"body" and captures["<a>"].response.target_uri == "http://a/"
    assert [r.record_id for r in captures["<r>"].requests] == ["<q>"]
    assert captures["<gone>"].response is None and len(captures["<gone>"].requests) == len(captures["<gone>"].metadata) == 1
    flat = {r.payload_digest: r for r in warc.resolved(warc.read_captures(spark, str(tmp_path))).collect()}
    assert flat["0" * 64].record_type == "revisit" and flat["0" * 64].payload_bytes is None and flat["0" * 64].refers_to is None


def test_pieces_of_a_stream_do_not_matter(monkeypatch):
    data = b"".join(gzip.compress(written("response", f"<{i}>", b"H\r\n\r\n" + b"y" * i)) for i in range(40))
    whole = [(f["warc-record-id"], b) for f, _, b in warc.parsed(memoryview(data))]
    monkeypatch.setattr(warc, "PIECE", 7)
    assert [(f["warc-record-id"], b) for f, _, b in warc.parsed(memoryview(data))] == whole and len(whole) == 40
    plain = gzip.decompress(data)
    assert [(f["warc-record-id"], b) for f, _, b in warc.parsed(memoryview(plain))] == whole


def order_of(turn):
    number, role, text = turn
    digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return (number is not None, number or 0, digest)


def brute_rebuilt(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x, key=order_of)] for c, x in own.items()}
    out = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + x[h:]
    return out


def brute_nodes(found):
    members = defaultdict(list)
    for c in sorted(found):
        for d in range(len(found[c]) + 1):
            members[tuple(found[c][:d])].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += p not in children
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(found[c]) == len(p))
        parent = members[p[:-1]][0] if p else None
        out.append((m[0], len(p), parent, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed, n=260):
    """Conversations with shared openings, equal ones, prefixes of others, and none of their own turns."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-300, 900), n):
        kind = rng.random()
        if kind < 0.3:
            words = ["hello", "hi", "same", "end"]
        elif kind < 0.8:
            words = [rng.choice(["hello", "hé", ""]) for _ in range(rng.randrange(9))]
        else:
            words = ["hello"] * rng.randrange(14)
        rows += [(c, i, ["user", None, "bot"][i % 3], w) for i, w in enumerate(words)]
    rows += [(1000, 0, "u", "x"), (1000, 1, "u", None), (1001, None, "u", "before"), (1001, 0, "u", "a"), (1001, 0, "u", "b"), (1001, 0, "u", "b")]
    rows += [(None, 0, "u", "nobody"), (1003, 0, "u", "long " * 300_000), (1010, 3, "u", "only"), (1007, 0, "us", "er"), (1007, 1, "user", "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns_a_part", [9, 40, 100_000])
def test_trie_against_brute_force(spark, turns_a_part):
    """However small the parts are, so that most prefixes and runs cross borders."""
    rows = talks(turns_a_part)
    built = prefix_trie.rebuilt(turns(spark, rows))
    got = prefix_trie.nodes(built, turns_a_part)
    assert got.columns == prefix_trie.NODES.names
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_nodes(brute_rebuilt(rows))


def test_trie_of_few_rows(spark):
    assert prefix_trie.prefix_trie(turns(spark, [(1, 0, "u", "x")]).limit(0)).count() == 0
    assert prefix_trie.prefix_trie(turns(spark, [(None, 0, "u", "x")])).count() == 0
    shape = "conv_id long, digests binary, chars array<int>"
    none = spark.createDataFrame([(5, b"", []), (3, b"", [])], shape)
    rows = prefix_trie.nodes(none, 1).collect()
    assert [tuple(r) for r in rows] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]
    twins = spark.createDataFrame([(i, b"a" * 64, [1, 2, 3, 4]) for i in range(60)] + [(60, b"a" * 48, [1, 2, 3])], shape)
    rows = {r.depth: r for r in prefix_trie.nodes(twins, 7).collect()}
    assert {d: (r.n_convs, r.n_children, r.n_leaves) for d, r in rows.items()} == {0: (61, 1, 1), 1: (61, 1, 1), 2: (61, 1, 1), 3: (61, 1, 1), 4: (60, 0, 1)}
    assert rows[4].ends_sha256 == hashlib.sha256(",".join(map(str, range(60))).encode()).hexdigest() and rows[2].saved_tokens == 2 * 60 + 3 * 60 + 4 * 59


def test_sparse_table_searches():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 5, 101)
    table = prefix_trie.SparseTable(values)
    at, depth = rng.integers(0, 101, 400), rng.integers(0, 6, 400)
    right = [next((j - 1 for j in range(a + 1, 101) if values[j] < d), 100) for a, d in zip(at, depth, strict=True)]
    left = [next((j for j in range(a, -1, -1) if values[j] < d), -1) for a, d in zip(at, depth, strict=True)]
    assert table.right(at, depth).tolist() == right and table.left(at, depth).tolist() == left
    last = np.minimum(at + rng.integers(0, 50, 400), 100)
    assert table.least(at, last).tolist() == [values[a : b + 1].min() for a, b in zip(at, last, strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int, id string, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], VECTORS)


def brute_whiten(rows, top=32):
    """Exact sums in whole numbers, then numpy."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    apart = [[n * c - s for c, s in zip(row, sums, strict=True)] for row in x]
    centred = np.array(apart, float) / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1][:top], parts[:, ::-1][:, :top]
    return [sum(c * c for c in row) for row in apart], centred @ parts / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def held(rows, found, top=32):
    deviation, white, share = brute_whiten(rows, top)
    by_row = defaultdict(dict)
    for r in found:
        assert r.n == len(rows) and r.identity_error <= 1e-4 and math.isclose(r.explained, share[r.component - 1], rel_tol=1e-6)
        by_row[r.id, r.deviation].setdefault(r.component, []).append(r.whitened)
    got = {k: np.array([v[c] for c in sorted(v)]) for k, v in by_row.items()}
    signs = None
    for (i, _), d, w in zip(rows, deviation, white, strict=True):
        own = got[i, d][:, 0]
        signs = np.sign(own * w) if signs is None else signs
        assert np.allclose(own, signs * w, rtol=1e-6, atol=1e-8)
    assert len(found) == len(rows) * white.shape[1]


def test_op13_against_numpy(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found = queries.QUERIES["op13_whitening"](spark, sf_dir)
    held(rows, found.withColumnRenamed("vec_id", "id").collect())


def test_whitening_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS_A_BLOCK", 16)
    monkeypatch.setattr(whitening, "BLOCKS_A_SPLIT", 2)
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(6, 6)) * [3, 2, 1, 0.7, 0.5, 0.2]
    good = [(i, [float(c) for c in np.float32(rng.normal(size=6) @ mixed)]) for i in range(300)] + [(None, [1.0] * 6), (None, [2.0] * 5 + [-7.0])]
    good += [(7, good[7][1])] * 3
    nan, inf = float("nan"), float("inf")
    bad = [(400, None), (401, []), (402, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (403, [nan] * 6), (404, [inf] + [0.0] * 5), (405, [1.0, 2.0]), (406, [1e30] * 6)]
    frame = vectors(spark, good + bad).repartition(5)
    held(good, whitening.whiten(frame).collect())
    held(good, whitening.whiten(frame, top=4).collect(), 4)


def test_large_entries_are_exact(spark):
    """Sums beyond 64 bits go through decimals; a deviation beyond them is null."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=3) * 1e13]) for i in range(3000)]
    deviation, white, _ = brute_whiten(rows)
    found = {(r.id, r.component): r for r in whitening.whiten(vectors(spark, rows)).collect()}
    for (i, _), d, w in zip(rows, deviation, white, strict=True):
        assert found[i, 1].deviation == (d if d < 1 << 63 else None) and math.isclose(abs(found[i, 1].whitened), abs(w[0]), rel_tol=1e-6, abs_tol=1e-9)


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])]).limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 3.0, 2.0 * i]) for i in range(10)])).orderBy("id", "component").collect()
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in flat) and math.isclose(flat[0].explained, 1.0)
