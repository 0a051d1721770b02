"""Learned operators: exact code lengths, exact marginals, held-out accuracy."""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import language_id, line_crf, queries
from tickloom.llm.common import text_buffers


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def plain_bits(counts, order, text, label):
    """Code length of a text by the definition, without any table."""
    seen: dict[tuple[str, bytes], dict[int, int]] = {}
    for lang, word, n in counts:
        path = b" " + word.encode() + b" "
        for i in range(1, len(path)):
            for k in range(min(order, i) + 1):
                after = seen.setdefault((lang, path[i - k : i]), {})
                after[path[i]] = after.get(path[i], 0) + n
    bits = 0.0
    for word in language_id.LETTERS.findall(text.lower()):
        path = b" " + word.encode() + b" "
        for i in range(1, len(path)):
            for k in range(min(order, i), -1, -1):
                after = seen.get((label, path[i - k : i]), {})
                total, kinds = sum(after.values()), len(after)
                if path[i] in after:
                    bits -= math.log2(after[path[i]] / (total + kinds))
                    break
                if kinds:
                    bits -= math.log2(kinds / (total + kinds))
            else:
                bits += math.log2(257)
    return bits


COUNTS = [("en", "the", 5), ("en", "then", 2), ("en", "house", 1), ("de", "das", 4), ("de", "haus", 2), ("de", "dann", 1), ("fr", "été", 3)]


@pytest.mark.parametrize("text", ["the house", "Das Haus, dann!", "qqq été then", "ß", "thethethe x9y", "hé"])
def test_code_lengths_are_exact(text):
    trees = language_id.Trees(COUNTS)
    bits, runs, coded = language_id.Scorer(trees)(pa.array([text]))
    assert coded[0] == sum(len(w.encode()) + 1 for w in language_id.LETTERS.findall(text.lower()))
    expected = [plain_bits(COUNTS, language_id.ORDER, text, label) for label in ("de", "en", "fr")]
    assert trees.languages == ["de", "en", "fr"] and runs[0] == len(language_id.LETTERS.findall(text.lower()))
    assert np.allclose(bits[0], expected)


def test_word_memory_does_not_change_scores():
    texts = pa.array(["the house and das haus", "", None, " été the\n", "then dann " * 50, "x" * 100])
    trees = language_id.Trees(COUNTS)
    small = language_id.Scorer(trees, cached=1)
    for _ in range(3):
        assert np.allclose(small(texts)[0], language_id.Scorer(trees)(texts)[0])


def test_language_cases(documents):
    rows = [(i, "the cat and the dog went over there", "en") for i in range(12)]
    rows += [(20 + i, "der hund und die katze gingen dorthin", "de") for i in range(12)]
    rows += [(50, None, "en"), (51, "", "en"), (52, "123 --- 456", "de"), (53, "the dog", None), (None, "die katze", "de"), (53, "the dog", None)]
    docs = documents(rows)
    got = language_id.predict(docs, language_id.fit(docs)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [by_id[i].lang_pred for i in (50, 51, 52)] == ["und"] * 3 and by_id[51].score == 0
    assert by_id[53].lang_pred == "en" and by_id[None].lang_pred == "de" and not by_id[None].held_out
    assert all(r.held_out == held_out(r.doc_id) for r in got)
    nothing = language_id.predict(docs, language_id.fit(docs.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language_id.predict(docs.limit(0), language_id.fit(docs)).count() == 0


def test_prediction_ignores_labels(documents):
    rows = [(i, "the cat and the dog went over there" if i % 2 else "der hund und die katze gingen", "en" if i % 2 else "de") for i in range(40)]
    trees = language_id.fit(documents(rows))
    swapped = documents([(i + 1000, t, "xx") for i, t, _ in rows])
    plain = {r.doc_id: r.lang_pred for r in language_id.predict(documents(rows), trees).collect()}
    assert {r.doc_id - 1000: r.lang_pred for r in language_id.predict(swapped, trees).collect()} == plain


def test_op4_held_out_accuracy(spark, sf_001):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_001}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op4_language_id"](spark, sf_001).collect()
    assert {r.doc_id for r in rows} == set(lang) and len(rows) == len(lang)
    tested = [r for r in rows if r.held_out]
    assert len(tested) > 150 and all(r.held_out == held_out(r.doc_id) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in tested]) > 0.97


def buffers(texts):
    return text_buffers(pa.array(texts, pa.string()))


def test_lines():
    data, starts = buffers(["a\nbb\n", "", "c", "\n", None])
    bounds, per_text = line_crf.line_bounds(data, starts)
    assert per_text.tolist() == [3, 1, 1, 2, 1]
    assert (bounds[1] - bounds[0]).tolist() == [1, 2, 0, 0, 1, 0, 0, 0]
    features = line_crf.line_features(data, bounds)
    assert features.shape == (8, line_crf.N_FEATURES) and np.isfinite(features).all()
    spread = line_crf.with_neighbours(features, per_text)
    n = line_crf.N_FEATURES
    assert (spread[0, n : 2 * n] == 0).all() and (spread[1, n : 2 * n] == features[0]).all() and (spread[2, 2 * n :] == 0).all()


def test_features_do_not_depend_on_the_batch(monkeypatch):
    texts = ["One line of text.\nANOTHER!! LINE\n| x | y |", "", "same same same\n" * 20, "é" * 50]
    whole = line_crf.line_features(*_parts(texts))
    monkeypatch.setattr(line_crf, "BLOCK_BYTES", 16)
    assert (line_crf.line_features(*_parts(texts)) == whole).all()
    alone = np.concatenate([line_crf.line_features(*_parts([t])) for t in texts])
    assert (alone == whole).all()


def _parts(texts):
    data, starts = buffers(texts)
    return data, line_crf.line_bounds(data, starts)[0]


def test_marginals_are_exact():
    rng = np.random.default_rng(2)
    per_text = np.array([4, 1, 3])
    emission, transition = rng.normal(size=8), rng.normal(size=(2, 2))
    got, pairs = line_crf.marginals(emission, transition, per_text)
    expected, expected_pairs, at = [], np.zeros((2, 2)), 0
    for n in per_text:
        weights, good, joint = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(emission[at + i] * y for i, y in enumerate(labels)) + sum(transition[a, b] for a, b in zip(labels, labels[1:])))
            weights += w
            good += w * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                joint[a, b] += w
        expected += list(good / weights)
        expected_pairs += joint / weights
        at += n
    assert np.allclose(got, expected) and np.allclose(pairs, expected_pairs)


def test_quality_cases(spark, documents):
    good, bad = "A plain sentence of words here.\nAnd one more of them.", "BUY!! NOW!! | $$$ | ### | BUY!!\nBUY!! NOW!!"
    rows = [(i, good if i % 2 else bad) for i in range(60)] + [(70, None), (71, ""), (None, good), (72, bad), (72, bad)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (70, None, 0), (71, 5, 0)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    field = line_crf.fit(docs, labels)
    got = line_crf.predict(docs, field).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    score = {r.doc_id: r.score for r in got}
    assert score[1] > 0.9 and score[2] < 0.1 and score[72] < 0.1 and score[None] > 0.9 and score[70] == score[71]
    assert all(r.held_out == held_out(r.doc_id) for r in got)
    assert {r.score for r in line_crf.predict(docs, line_crf.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert line_crf.predict(docs.limit(0), field).count() == 0


def test_op9_held_out_accuracy(spark, sf_001):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_001}/labels.parquet").collect()}
    rows = queries.QUERIES["op9_line_crf"](spark, sf_001).collect()
    assert len(rows) == spark.read.parquet(f"{sf_001}/documents.parquet").count()
    tested = [r for r in rows if r.held_out and r.doc_id in quality]
    bad = [r.score for r in tested if quality[r.doc_id] == 0]
    good = [r.score for r in tested if quality[r.doc_id] == 1]
    above = np.mean([[g > b for g in good] for b in bad])
    assert above > 0.95
    assert np.mean([r.predicted == quality[r.doc_id] for r in tested]) > 0.93
