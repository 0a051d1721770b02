"""Permutation index, fingerprints and license scans against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import license_scan, permutation_index, queries, weighted_sampling


def brute_nearest(rows, queries_of, k):
    usable = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in usable:
        if queries_of(i):
            d = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in usable if j != i and len(v) == len(q))
            out[i] = d[:k]
    return out


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i), 1.0, float(i % 3)]) for i in range(1, 40)] + [(i, [1.0, 1.0, 1.0]) for i in range(40, 80)]
    rows += [(100, None), (101, [0.0, 0.0, 0.0]), (102, [nan, 1.0, 1.0]), (103, [inf, 1.0, 1.0]), (104, [None, 1.0, 1.0]), (105, [1.0, 2.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (40, [1.0, 1.0, 1.0]), (200, [3.0, 1.0, 0.5])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    got = permutation_index.search(frame, F.col("vec_id") % 5 == 0, pivots=8, ordered=4, share=1.0, shard=16)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    expected = brute_nearest([r for r in set((i, tuple(v) if v else None) for i, v in rows)], lambda i: i % 5 == 0, 10)
    assert found == {i: d for i, d in expected.items() if d}
    assert permutation_index.search(frame.limit(0), F.lit(True)).count() == 0
    assert permutation_index.search(frame, F.lit(False)).count() == 0


def test_blocks_of_queries_do_not_change_results(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    some = F.col("vec_id") % 25 == 0
    whole = sorted(map(tuple, permutation_index.search(frame, some).collect()))
    assert sorted(map(tuple, permutation_index.search(frame, some, block=3).collect())) == whole


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_op3_recall(spark, size):
    folder = f"/root/testdata/{size}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    expected = brute_nearest(rows, lambda i: i % 100 == 0, 10)
    found = {}
    for r in queries.QUERIES["op3_permutation_index"](spark, folder).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(expected)
    vectors = dict(rows)
    hits = 0
    for i, near in found.items():
        assert [r for r, _, _ in near] == list(range(1, 11))
        for _, j, score in near:
            assert j != i and abs(score - np.linalg.norm(np.array(vectors[i]) - np.array(vectors[j]))) < 1e-9
        hits += len({j for _, j, _ in near} & {j for _, j in expected[i]})
    assert hits / (10 * len(expected)) >= 0.9


def generalised_jaccard(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return sum((x & y).values()) / sum((x | y).values())


def test_agreement_is_generalised_jaccard():
    rng = random.Random(4)
    sample = weighted_sampling.Sampler(samples=512)
    for _ in range(12):
        words = [f"w{i}" for i in range(60)]
        a = rng.choices(words, k=150)
        b = a[: rng.randrange(20, 150)] + rng.choices(words, k=60)
        expected = generalised_jaccard(" ".join(a), " ".join(b))
        got = weighted_sampling.likeness(sample(" ".join(a)), sample(" ".join(b)))
        assert abs(got - expected) < 5 * (expected * (1 - expected) / 512) ** 0.5 + 0.01


def plain_fingerprint(text, samples):
    """The draws and the choice by their definition, one word and sample after the other."""
    m64 = (1 << 64) - 1

    def mixed(x):
        for _ in range(2):
            x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & m64
        return x ^ x >> 32

    def once(x):
        x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & m64
        return x ^ x >> 32

    lanes = [[mixed((i * samples + j + 1) * 0x9E3779B97F4A7C15 & m64) for j in range(samples)] for i in range(3)]
    counts = Counter(text.encode().split())
    out = ""
    for j in range(samples):
        best = None
        for word, n in counts.items():
            h = xxhash.xxh3_64_intdigest(word)
            u = [[((x >> 41) + 0.5) / 2**23, ((x & 0x7FFFFF) + 0.5) / 2**23] for x in (once(h ^ lane[j]) for lane in lanes)]
            r, ln_c, b = -math.log(u[0][0] * u[0][1]), math.log(-math.log(u[1][0] * u[1][1])), u[2][0]
            t = math.floor(math.log(n) / r + b)
            value = ln_c - r * (t - b) - r
            if best is None or (value, h) < best[:2]:
                best = (value, h, t)
        out += f"{mixed(best[1] ^ mixed(best[2] + 1)) >> 48:04x}"
    return out


def test_fingerprints_against_the_definition():
    rng = random.Random(11)
    sample = weighted_sampling.Sampler(samples=48)
    for n in (1, 2, 30, 200):
        text = " ".join(rng.choices([f"wörd{i}" for i in range(40)], k=n))
        assert sample(text) == plain_fingerprint(text, 48)


def test_fingerprints_do_not_depend_on_memory():
    texts = ["a b c a", "c b a a", "x " * 30, "", None, "new words here", "a", "a a b b c c d d e e"]
    small, large = weighted_sampling.Sampler(cached=2, repeated=2), weighted_sampling.Sampler()
    prints = [large(t or "") for t in texts]
    assert [small(t or "") for t in texts] == prints and prints[0] == prints[1] and prints[3] == prints[4] == small.empty


def edited(rows):
    # Descending ids, nulls last; equal ids are told apart by the operator.
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        yield doc_id, text, after, text[: len(text) - half] + after[:half]


def check_edited(rows, got):
    assert len(got) == len(rows)
    sample = weighted_sampling.Sampler()
    found = {r.doc_id: r for r in got}
    for doc_id, text, after, changed in edited(rows):
        r = found[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (sample(text), sample(changed))
        assert r.near_edited == weighted_sampling.likeness(sample(text), sample(changed))
        assert r.near_next == weighted_sampling.likeness(sample(text), sample(after))


@pytest.mark.parametrize("ranges", [1, 5])
def test_edited_texts(documents, ranges):
    rows = [(i * 3, f"text number {i} 🙂 " * (i % 7)) for i in range(60)] + [(None, "no id"), (500, None), (501, "")]
    check_edited(rows, weighted_sampling.edited_fingerprints(documents(rows), ranges=ranges).collect())
    check_edited(rows[:1], weighted_sampling.edited_fingerprints(documents(rows[:1]), ranges=ranges).collect())
    twice = weighted_sampling.edited_fingerprints(documents([(1, "a b"), (1, "a b"), (1, "c"), (2, "d")]), ranges=ranges).collect()
    assert len(twice) == 4
    assert weighted_sampling.edited_fingerprints(documents(rows).limit(0), ranges=ranges).count() == 0


def test_plain_fingerprints(documents):
    rows = [(1, "a b c"), (2, None), (3, "a b c")]
    got = {r.doc_id: r.fingerprint for r in weighted_sampling.fingerprints(documents(rows)).collect()}
    assert got[1] == got[3] != got[2] == weighted_sampling.Sampler().empty


def test_op8_weighted_sampling(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_edited(rows, queries.QUERIES["op8_weighted_sampling"](spark, sf_dir).collect())


def test_increasing_subsequences():
    rng = random.Random(1)
    for _ in range(200):
        places = rng.sample(range(30), rng.randrange(0, 9))
        chain = [places[i] for i in license_scan.in_order(places)]
        assert chain == sorted(chain)
        best = max((len(s) for n in range(1 << len(places)) if (s := [p for i, p in enumerate(places) if n >> i & 1]) == sorted(s)), default=0)
        assert len(chain) == best


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert license_scan.common_length(a, b) == table[-1][-1]
        assert license_scan.aligned(a, b) <= table[-1][-1]


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_licenses_are_found(documents, name):
    body = license_scan.TEMPLATES[name]
    words = body.split()
    changed = " ".join([*words[: len(words) // 2], "extra", *words[len(words) // 2 :]])
    wrapped = "\n".join("# " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    rows = [(1, "Foreign prose stands here, seven words long.\n" * 3 + wrapped.upper() + "\n" + "Foreign prose again stands here, seven words long.\n" * 3)]
    rows += [(2, changed), (3, "nothing of the kind, and all of it is in the open"), (4, None), (None, body), (2, changed), (6, body + " " + body)]
    got = license_scan.scan(documents(rows)).filter(F.col("license") == name).collect()
    assert Counter(r.doc_id for r in got) == Counter({1: 1, 2: 2, None: 1, 6: 1})
    assert all(r.coverage == 1 for r in got)


def plain_cover(template, words):
    table = [[0] * (len(words) + 1) for _ in range(len(template) + 1)]
    for i, x in enumerate(template):
        for j, y in enumerate(words):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1] / len(template)


def test_op5_license_scan(spark, sf_dir):
    texts = {r.doc_id: license_scan.words_of(r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op5_license_scan"](spark, sf_dir).collect()
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    found = {(r.doc_id, r.license, r.first_word) for r in got}
    assert got and license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)).count() == 0
    for r in got:
        assert license_scan.COVERAGE <= r.coverage <= plain_cover(scanner.templates[r.license], texts[r.doc_id][r.first_word : r.end_word]) + 1e-9
    # Without any shortcut: no region that a full alignment covers is missed where its words are in order.
    for doc_id, words in texts.items():
        for name, template in scanner.templates.items():
            for a, b in scanner.regions(name, words):
                if license_scan.aligned(template, words[a:b]) >= license_scan.COVERAGE * len(template):
                    assert (doc_id, name, a) in found


LONG = sorted(name for name, body in license_scan.TEMPLATES.items() if len(license_scan.words_of(body)) >= 25)


def test_a_license_cut_by_a_tag_is_found():
    words = license_scan.TEMPLATES["MIT"].split()
    i = words.index("limitation")
    text = " ".join([*words[:i], '</p><p class="legal small" style="margin-top:12px">', *words[i:]])
    assert [(r[0], r[3]) for r in license_scan.Scanner(license_scan.TEMPLATES)(text) if r[0] == "MIT"] == [("MIT", 1.0)]


@pytest.mark.parametrize("foreign", [7, 20, 50])
@pytest.mark.parametrize("name", LONG)
def test_interrupted_licenses_are_found(name, foreign):
    scanner = license_scan.Scanner({name: license_scan.TEMPLATES[name]})
    template = scanner.templates[name]
    size, noise = len(template), [f"zz{i}" for i in range(foreign)]
    between = [f"yy{i}" for i in range(10)]
    for cut in (size // 10, size // 3, size // 2, size - size // 10):
        copy = [*template[:cut], *noise, *template[cut:]]

        def places(*parts):
            return [(a, b, c) for _, a, b, c in scanner(" ".join(w.decode() if isinstance(w, bytes) else w for p in parts for w in p))]

        n, k = len(copy), len(between)
        assert places(between, copy, between) == [(k, k + n, 1.0)]
        # Each of several interrupted copies, and one beside a whole copy.
        assert places(copy, between, copy) == [(0, n, 1.0), (n + k, n + k + n, 1.0)]
        assert places(template, between, copy) == [(0, size, 1.0), (size + k, size + k + n, 1.0)]
        assert places(copy, between, template) == [(0, n, 1.0), (n + k, n + k + size, 1.0)]


def test_two_adjacent_copies_are_one_region_over_both():
    for name in LONG:
        scanner = license_scan.Scanner({name: license_scan.TEMPLATES[name]})
        size = len(scanner.templates[name])
        for foreign in range(license_scan.GAP + 1):
            text = " ".join([license_scan.TEMPLATES[name], "zz " * foreign, license_scan.TEMPLATES[name]])
            assert scanner(text) == [(name, 0, 2 * size + foreign, 1.0)]
        text = " ".join([license_scan.TEMPLATES[name], "zz " * (license_scan.GAP + 1), license_scan.TEMPLATES[name]])
        assert [r[1:3] for r in scanner(text)] == [(0, size), (size + license_scan.GAP + 1, 2 * size + license_scan.GAP + 1)]


def licenses_in(text):
    return {r[0] for r in license_scan.Scanner(license_scan.TEMPLATES)(text)}


def test_wordings_of_a_family_are_told_apart():
    bodies = license_scan.TEMPLATES
    for family in license_scan.FAMILIES:
        for name in family:
            assert licenses_in(f"zz zz {bodies[name]} zz") & family == {name}
        some = sorted(family)
        for one, other in zip(some, some[1:], strict=False):
            assert licenses_in(f"{bodies[one]} zz {bodies[other]}") & family >= {x for x in (one, other) if not x.endswith("-opening")}
    two, three = bodies["BSD-2-Clause"], bodies["BSD-3-Clause"]
    named = three.replace("the copyright holder nor", "the University of Somewhere nor")
    assert "BSD-2-Clause" in licenses_in(two) and "BSD-3-Clause" not in licenses_in(two)
    assert "BSD-3-Clause" in licenses_in(named) and "BSD-2-Clause" not in licenses_in(named)
    assert {"BSD-2-Clause", "BSD-3-Clause"} <= licenses_in(two + " " + three)
    assert licenses_in(three + " " + three) == {"BSD-3-Clause"}


def test_templates_are_whole():
    ends = {
        "MIT": "other dealings in the software",
        "ISC": "use or performance of this software",
        "BSD-2-Clause": "possibility of such damage",
        "BSD-3-Clause": "possibility of such damage",
        "Apache-2.0": "limitations under the license",
        "GPL-3.0": "www gnu org licenses",
        "MPL-2.0": "mozilla org mpl 2 0",
    }
    for name, end in ends.items():
        assert b" ".join(license_scan.words_of(license_scan.TEMPLATES[name])).decode().endswith(end)
    for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0"):
        assert len(license_scan.words_of(license_scan.TEMPLATES[f"{name}-text"])) > 1000
    # An opening without the rest is found, and is not the license.
    assert licenses_in(license_scan.TEMPLATES["MIT-opening"]) == {"MIT-opening"}


def test_templates_are_an_argument(documents):
    got = license_scan.scan(documents([(1, "some house rules for all who work here")]), {"House": "house rules for all who work here"}).collect()
    assert [(r.doc_id, r.license, r.coverage) for r in got] == [(1, "House", 1.0)]
