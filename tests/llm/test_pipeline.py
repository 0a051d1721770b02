"""The pipeline against its stages done by brute force."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from test_dedup import brute_near
from tokenizers import Tokenizer

import corpus_pipeline
from tickloom.llm import language_id, line_crf, packing
from tickloom.llm.common import text_buffers


def without_repeated_bytes(rows, width):
    counts: dict[bytes, int] = {}
    bodies = [t.encode() for _, t in rows]
    for b in bodies:
        for i in range(len(b) - width + 1):
            counts[b[i : i + width]] = counts.get(b[i : i + width], 0) + 1
    out = []
    for (doc_id, _), b in zip(rows, bodies, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if counts[b[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append((doc_id, bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")))
    return out


def test_rows_against_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.orderBy("doc_id").collect()]
    trees = language_id.fit(table, limits=True)
    bits, runs, coded = language_id.Scorer(trees)(pa.array([t for _, t in rows], pa.string()))
    share = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
    most = np.array(trees.limits)[bits.argmin(axis=1)] * (1 + language_id.SHORT / np.maximum(coded, 1))
    fits = bits.min(axis=1) / np.maximum(coded, 1) <= most
    rows = [r for r, n, p, f in zip(rows, runs, share, fits, strict=True) if n and p >= corpus_pipeline.LANGUAGE_SHARE and f]
    known = table.filter(table.doc_id.isin([i for i, _ in rows]))
    field = line_crf.fit(known, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = field.scores(*text_buffers(pa.array([t for _, t in rows], pa.string())))
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= line_crf.THRESHOLD]
    kept = {d for d, _, _, own in brute_near(rows, 5, 80) if own}
    rows = without_repeated_bytes([r for r in rows if r[0] in kept], 200)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID] for d, t in rows}
    found: dict[int, list[int]] = {}
    for p in corpus_pipeline.run(spark, sf_dir).orderBy("doc_id", "start").collect():
        assert len(p.ids) == p.length and p.length & (p.length - 1) == 0
        found.setdefault(p.doc_id, []).extend(p.ids)
    assert found == expected and len(found) < table.count()


def test_stages_keep_the_columns(spark, documents, sf_dir):
    rows = [(i, f"Some plain words stand here, number {i}, and a few more of them follow after that.") for i in range(30)]
    rows += [(40, None), (41, ""), (42, "1 2 3"), (None, "These words have no id."), (None, "These words have no id."), (7, "other text, same id")]
    docs = documents(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        assert kept.filter("source <> 'src' or `start` <> 'x' or length <> 1").count() == 0
    left = corpus_pipeline.without_near_duplicates(spark, docs, sf_dir).collect()
    assert sum(r.doc_id == 7 for r in left) == 1 and sum(r.doc_id is None for r in left) == 2
    assert {r.doc_id for r in corpus_pipeline.known_language(spark, docs, sf_dir).collect()}.isdisjoint({40, 41, 42})


def test_clean_documents_stay(spark, sf_001):
    """Held-out documents labelled good pass both filters, but for a few."""
    table = spark.read.parquet(f"{sf_001}/documents.parquet")
    labels = spark.read.parquet(f"{sf_001}/labels.parquet").filter("quality = 1")
    clean = {r.doc_id for r in labels.collect()}
    docs = corpus_pipeline.known_language(spark, table, sf_001)
    docs = corpus_pipeline.good_quality(spark, docs, sf_001)
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(clean & kept) > 0.97 * len(clean)
