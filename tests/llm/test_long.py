"""A text longer than an Arrow batch through the operators that read texts whole."""

from __future__ import annotations

import hashlib
import random

import pytest

from tickloom.llm import language_id, license_scan, line_crf, minhash, packing, warc, weighted_sampling
from tickloom.llm.common import BATCH_BYTES


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(8)
    words = [f"{rng.choice(['the', 'house', 'river', 'stone'])}{rng.randrange(3000)}" for _ in range(20_000)]
    lines = [" ".join(rng.choices(words, k=14)) + "." for _ in range(95_000)]
    lines[40_000] = license_scan.TEMPLATES["MIT"]
    text = "\n".join(lines)
    assert len(text.encode()) > BATCH_BYTES
    return text


@pytest.fixture(scope="module")
def docs(documents, long_text):
    short = [(i, "the house by the river is made of stone and wood", "en") for i in range(10, 22)]
    other = [(i, "das haus am fluss ist aus stein und aus holz gebaut", "de") for i in range(30, 42)]
    near = long_text.replace("river1 ", "rivers ")
    return documents([(1, long_text, "en"), (2, near, "en"), (3, None, None), (4, "", "en"), *short, *other])


def test_models_read_it_whole(spark, docs):
    told = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert told[1].lang_pred == "en" and told[30].lang_pred == "de" and told[3].lang_pred == "und"
    labels = spark.createDataFrame([(i, int(i < 30)) for i in [*range(10, 22), *range(30, 42)]], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in line_crf.predict(docs, line_crf.fit(docs, labels)).collect()}
    assert len(scores) == 28 and all(0 <= x <= 1 for x in scores.values())


def test_near_copies_of_it_are_linked(docs):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert got[2].component_id == 1 and not got[2].kept and got[1].n_shingles > 1_000_000
    assert got[3].n_shingles == got[4].n_shingles == 0 and got[3].kept


def test_a_license_in_it_is_found(docs):
    found = {(r.doc_id, r.license) for r in license_scan.scan(docs).select("doc_id", "license").collect()}
    assert {(1, "MIT"), (2, "MIT")} <= found


def test_its_edited_text(docs, long_text):
    got = {r.doc_id: r for r in weighted_sampling.edited_fingerprints(docs).collect()}
    assert got[1].n_chars == len(long_text) and got[2].near_next > 0.9
    after = {r.doc_id: r.text for r in docs.collect()}
    half = len(after[2]) // 2
    changed = after[2][: len(after[2]) - half] + long_text[:half]
    assert got[2].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()


def test_its_pieces_and_its_archive(spark, docs, long_text):
    import public_tokenizers

    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True).filter("doc_id = 1").collect()
    assert sum(p.length for p in pieces) == pieces[0].doc_tokens > 1_000_000
    back = {r.row_id: r for r in warc.round_trip(docs.withColumnRenamed("lang", "url").withColumnRenamed("text", "html").withColumnRenamed("doc_id", "page_id")).collect()}
    assert back[1].payload_bytes == len(long_text.encode()) and back[1].payload_digest == hashlib.sha256(long_text.encode()).hexdigest()
