"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. Its features are figures of the line
itself and of the lines before and behind it; neighbouring labels are tied by
transition weights. Forward-backward gives each line's probability of being
good, and their mean, weighted by line length, is the score of the document.

The weights are fitted to a bounded sample of labelled documents (`per_label`
of each quality, `sample_chars` characters at most) by gradient ascent on the
conditional likelihood of lines that carry their document's label. Scoring
reads every text whole and never looks at labels, lang, source or doc_id.

Defined cases: a null or empty text is one empty line; rows with a null doc_id
are not held out and not learned from; with no labelled rows every score is
0.5; repeated rows get equal results; labels other than 0 and 1 are not learned
from, and a document labelled twice is learned from twice; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import crc_residue, prepare, text_buffers
from tickloom.llm.language_id import learning_sample, segment_sums

PER_LABEL = 1000
SAMPLE_CHARS = 30_000
STEPS = 200
RATE = 0.08
RIDGE = 2e-3
THRESHOLD = 0.7
BLOCK_BYTES = 1 << 20

LOWER, UPPER, DIGIT, BLANK, STOP, BAR, MARK, HIGH, OTHER = range(9)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[128:] = HIGH
    for chars, value in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("0123456789", DIGIT)):
        kind[np.frombuffer(chars.encode(), np.uint8)] = value
    for chars, value in ((" \t\r\x0b\x0c", BLANK), (".,;:?'\"()-", STOP), ("|", BAR), ("!#$%&*+/<=>@[]^_{}~\\`", MARK)):
        kind[np.frombuffer(chars.encode(), np.uint8)] = value
    return kind


CLASSES = _byte_classes()
N_FEATURES = 16


def line_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines start and end (ends of texts included), and how many each text has."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(starts, breaks, "right") - 1
    per_text = np.bincount(owner, minlength=len(starts) - 1) + 1
    begin = np.sort(np.concatenate([breaks + 1, starts[:-1]]), kind="stable")
    end = np.sort(np.concatenate([breaks, starts[1:]]), kind="stable")
    return np.stack([begin, end]), per_text


def line_features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Figures of each line by itself."""
    begin, end = bounds
    n = len(begin)
    counts = np.zeros((n, 9))
    firsts = np.zeros((n, 2))
    raw = data.tobytes()
    cuts = np.unique(np.append(np.searchsorted(begin, np.arange(0, len(data) + 1, BLOCK_BYTES)), n))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = begin[a], end[b - 1]
        size = end[a:b] - begin[a:b]
        # Line breaks in between belong to the line before.
        line = np.repeat(np.arange(b - a), np.append(begin[a + 1 : b], hi) - begin[a:b])
        kind = CLASSES[data[lo:hi]]
        tally = np.bincount(line * 9 + kind, minlength=9 * (b - a)).reshape(b - a, 9).astype(float)
        broken = np.append(begin[a + 1 : b], hi) - begin[a:b] - size
        tally[:, OTHER] -= broken
        counts[a:b] = tally
    for i, (x, y) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        words = raw[x:y].split()
        firsts[i] = len(words), len(set(words))
    size = np.maximum(end - begin, 1)[:, None]
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER] + counts[:, HIGH], 1)
    words = np.maximum(firsts[:, 0], 1)
    share = counts / size
    features = np.zeros((n, N_FEATURES))
    features[:, 0] = 1
    features[:, 1] = np.log1p(end - begin) / 5
    features[:, 2:11] = np.sqrt(share)
    features[:, 11] = counts[:, UPPER] / letters
    features[:, 12] = np.log1p(letters / words)
    features[:, 13] = np.minimum(counts[:, MARK] / words, 3)
    features[:, 14] = 1 - firsts[:, 1] / words
    features[:, 15] = np.minimum(counts[:, STOP] / words, 3)
    return features


def with_neighbours(features: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """A line's own features, those of the line before and of the line behind (zero at the ends)."""
    ends = np.cumsum(per_text)
    before, behind = np.zeros_like(features), np.zeros_like(features)
    before[1:], behind[:-1] = features[:-1], features[1:]
    before[ends - per_text], behind[ends - 1] = 0, 0
    return np.concatenate([features, before, behind], axis=1)


def marginals(emission: np.ndarray, transition: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the summed probabilities of neighbouring label pairs.

    emission is the log weight of good against bad; transition[a, b] that of
    label b behind label a. Texts advance together, line by line.
    """
    ends = np.cumsum(per_text)
    begin = ends - per_text
    order = np.argsort(-per_text, kind="stable")
    lengths, first = per_text[order], begin[order]
    weight = np.exp(transition - transition.max())
    e = np.exp(-np.logaddexp(0, np.stack([emission, -emission], axis=1)))  # bad, good
    forward, backward = np.zeros_like(e), np.ones_like(e)
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(longest), "left")
    for t in range(longest):
        at = first[: alive[t]] + t
        alpha = e[at] if t == 0 else (forward[at - 1] @ weight) * e[at]
        forward[at] = alpha / alpha.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        ahead = e[at + 1] * backward[at + 1]
        beta = ahead @ weight.T
        joint = forward[at][:, :, None] * weight[None] * ahead[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        backward[at] = beta / beta.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), pairs


class LineCrf:
    def __init__(self, weights: np.ndarray, transition: np.ndarray):
        self.weights, self.transition = weights, transition

    def scores(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Length-weighted mean of P(good) over the lines of each text."""
        bounds, per_text = line_bounds(data, starts)
        good, _ = marginals(with_neighbours(line_features(data, bounds), per_text) @ self.weights, self.transition, per_text)
        length = (bounds[1] - bounds[0] + 1).astype(float)
        ends = np.concatenate([[0], np.cumsum(per_text)])
        return np.clip(segment_sums(good * length, ends) / segment_sums(length, ends), 0.0, 1.0)


def train(texts: list[str], labels: list[int], steps: int = STEPS) -> LineCrf:
    """Gradient ascent (Adam) on the conditional likelihood of the lines' labels."""
    width = 3 * N_FEATURES
    if not texts:
        return LineCrf(np.zeros(width), np.zeros((2, 2)))
    column = pa.array(texts, pa.string())
    data, starts = text_buffers(column)
    bounds, per_text = line_bounds(data, starts)
    x = with_neighbours(line_features(data, bounds), per_text)
    y = np.repeat(np.array(labels, float), per_text)
    # Every document weighs the same, however many lines it has.
    share = np.repeat(1 / per_text, per_text) / len(texts)
    theta = np.zeros(width + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (per_text - 1)[np.array(labels) == label].sum()
    lines = max(len(y), 1)
    for step in range(1, steps + 1):
        good, pairs = marginals(x @ theta[:width], theta[width:].reshape(2, 2), per_text)
        gradient = np.concatenate([x.T @ ((y - good) * share), ((seen - pairs) / lines).ravel()]) - RIDGE * theta / width
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return LineCrf(theta[:width], theta[width:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, sample_chars: int = SAMPLE_CHARS) -> LineCrf:
    """A field fitted to a bounded sample of the labelled rows that are not held out."""
    marked = labels.filter(F.col("quality").cast("int").isin(0, 1))
    sample = learning_sample(docs, "quality", crc_residue() != 2, per_label, sample_chars, marked)
    sample = sample.orderBy("label", "doc_id", "text").collect()
    return train([r.text for r in sample], [int(r.label) for r in sample])


def predict(docs: DataFrame, field: LineCrf, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, and the columns `keep` as they are: text by its
    name, others with `kept_` in front."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(field)
    held = F.coalesce(crc_residue() == 2, F.lit(False)).alias("held_out")
    rows = docs.select("doc_id", held, F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep if c != "text"])
    dropped = [] if "text" in keep else ["text"]
    out = rows.drop(*dropped).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts = text_buffers(batch.column("text"))
            scores = shared.value.scores(data, starts)
            rest = batch.drop_columns(dropped)
            columns = [*rest.columns, pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, out)
