"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to `ORDER` bytes with counts of
the byte that follows. A byte seen after the longest known context costs
-log2(n / (total + kinds)) bits; otherwise an escape, -log2(kinds / (total +
kinds)), is paid and the next shorter context decides, down to a uniform code.
The counts are frozen after learning, so a text has an exact code length under
every language; the shortest wins, and the score is the share of its
probability.

Words are coded one by one, from a blank to the blank behind them, in lower
case and letters only, so the code length of a text is the sum over its words
and each task remembers words it has met in a bounded table. The trees are
sorted arrays of integers: a string of up to six bytes is its own key.

The share only says which of the learned languages is the best. Whether a text
is one of them at all is told by its bits a byte: trees with `limits` know what
texts take that were kept back from learning.

Learning takes a bounded sample, `per_language` documents for each of the
`most_labels` most frequent languages and `sample_chars` characters of each,
chosen by hash among the rows allowed; prediction reads every text whole and
never looks at lang, source or doc_id.

Defined cases: null or letterless texts are `und` with score 0, as is
everything if no row can be learned from; rows with a null doc_id are not held
out and not learned from; rows with a null lang are predicted but not learned
from; repeated rows get equal results; ties go to the first language in order;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.common import Vocabulary, crc_residue, in_slices, prepare, record, saved, split_words, values_of

ORDER = 5
PER_LANGUAGE = 400
SAMPLE_CHARS = 60_000
MOST_LABELS = 256
CHECKED = 5
# A text fits up to twice the rate that few kept-back texts reach (three deviations); a short one gets more.
DEVIATIONS = 3
ALLOWED = 2.0
SHORT = 20
CACHED_WORDS = 200_000
BLOCK = 1 << 18
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def learning_sample(
    docs: DataFrame, label: str, allowed: Column, per_label: int, chars: int, labels: DataFrame | None = None, most_labels: int = MOST_LABELS
) -> DataFrame:
    """At most `per_label` rows (doc_id, text, label) of each of the `most_labels` most
    frequent labels, by hash, and of each text the first `chars` characters. Labels
    are a column of the documents, or of `labels` by doc_id.

    All rows are counted per label; the hash threshold that follows leaves a
    little more than wanted, and the rest is cut off in rank order. Only ids and
    hashes are joined and ranked; the chosen ones, bounded by the number of labels
    times `per_label`, then go out to fetch their texts. Repeated rows count once.
    """
    doc_id, place = F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("hash")
    texts = docs.select(doc_id, F.col("text").cast("string").alias("text"), *([label] if labels is None else []))
    keys = texts.filter(F.col("text").isNotNull()).withColumn("hash", place).drop("text")
    if labels is not None:
        keys = keys.join(labels.select(doc_id, label), "doc_id")
    keys = keys.select("doc_id", "hash", F.col(label).cast("string").alias("label")).filter(allowed & F.col("label").isNotNull())
    most = keys.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most_labels)
    counts = {r.label: r.n for r in most.collect()}
    enough = per_label + 6 * math.sqrt(per_label)
    shares = {name: math.ceil((1 << 20) * min(1.0, enough / n)) for name, n in counts.items()} or {"": 0}
    limits = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    few = keys.withColumn("part", F.pmod("hash", F.lit(1 << 20))).filter(F.col("part") < F.element_at(limits, F.col("label")))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("part", "hash", "doc_id"))
    chosen = few.distinct().withColumn("rank", rank).filter(F.col("rank") <= per_label).select("doc_id", "hash", "label").distinct()
    cut = F.substring("text", 1, chars).alias("text")
    found = texts.select("doc_id", "text").withColumn("hash", place).join(F.broadcast(chosen), ["doc_id", "hash"])
    return found.select("doc_id", "hash", "label", cut).dropDuplicates(["doc_id", "hash", "label"]).drop("hash")


def word_counts(sample: DataFrame) -> DataFrame:
    """label, word, n over the sample."""
    schema = pa.schema([("label", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labels, texts in values_of(batches, "label", "text"):
            seen: Counter = Counter()
            for label, text in zip(labels, texts, strict=True):
                seen.update((label, w) for w in LETTERS.findall(text.lower()))
            yield record(schema, [k[0] for k in seen], [k[1] for k in seen], list(seen.values()))

    counted = sample.select("label", "text").mapInArrow(run, "label string, word string, n long")
    return counted.groupBy("label", "word").agg(F.sum("n").alias("n"))


def segment_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows ends[i] to ends[i + 1], each by itself."""
    out = np.zeros((len(ends) - 1, *values.shape[1:]))
    filled = np.flatnonzero(ends[1:] > ends[:-1])
    if len(filled):
        out[filled] = np.add.reduceat(values[: ends[-1]], ends[filled], axis=0)
    return out


class Grams:
    """Byte strings of one length as sorted integers, with a row of bits each, one per language."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray):
        self.keys, self.bits = keys, bits

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are known, and the rows of those."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return known, at[known]


def paths(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words behind each other, each between two blanks, and the place of every byte in its own word."""
    data = np.frombuffer(b"".join([b" %s " % w for w in words]), np.uint8)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    return data, np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def rolled(data: np.ndarray, longest: int) -> list[np.ndarray]:
    """For every place the last 1, 2, ... `longest` bytes as an integer (garbage in front of the first byte)."""
    wide = data.astype(np.int64)
    out = [wide]
    for m in range(1, longest):
        ahead = np.concatenate([np.zeros(min(m, len(wide)), np.int64), wide[: max(len(wide) - m, 0)]])
        out.append(out[-1] | ahead << 8 * m)
    return out


class Trees:
    """Frozen context trees of all languages, as sorted arrays.

    A string of k + 1 bytes has the bits of its last byte behind the k others, per
    language, escapes to shorter contexts included; a context of k bytes has the
    bits of the escape alone, for bytes that no language has met there.
    """

    def __init__(self, counts: list[tuple[str, str, int]], order: int = ORDER):
        self.order = order
        self.languages = sorted({label for label, _, _ in counts})
        self.uniform = math.log2(257)
        self.limits: list[float] | None = None
        place = {x: i for i, x in enumerate(self.languages)}
        n = len(place)
        words = [word.encode() for _, word, _ in counts]
        data, local = paths(words)
        sizes = [len(w) + 2 for w in words]
        lang = np.repeat(np.array([place[x] for x, _, _ in counts], np.int64), sizes)
        times = np.repeat(np.array([t for _, _, t in counts], np.int64), sizes)
        self.grams: list[Grams] = []
        self.contexts: list[Grams] = []
        for k, keys in enumerate(rolled(data, order + 1)):
            on = local >= max(k, 1)
            own, row = np.unique(keys[on], return_inverse=True)
            seen = np.bincount(row * n + lang[on], times[on], len(own) * n).reshape(len(own), n)
            context, at = np.unique(own >> 8, return_inverse=True)
            total, kinds = np.zeros((len(context), n)), np.zeros((len(context), n))
            np.add.at(total, at, seen)
            np.add.at(kinds, at, seen > 0)
            escapes = np.where(total > 0, np.log2(np.maximum(total + kinds, 1)) - np.log2(np.maximum(kinds, 1)), 0.0)
            if k:
                shorter = self.grams[-1].bits[self.grams[-1].find(own & (1 << 8 * k) - 1)[1]]
            else:
                shorter = np.full((len(own), n), self.uniform)
            coded = np.log2(np.maximum(total + kinds, 1))[at] - np.log2(np.maximum(seen, 1))
            self.grams.append(Grams(own, np.where(seen > 0, coded, escapes[at] + shorter)))
            self.contexts.append(Grams(context, escapes))

    def bits(self, words: list[bytes]) -> np.ndarray:
        """Code length of each word in each language."""
        data, local = paths(words)
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        out = np.zeros((len(words), len(self.languages)))
        owner = np.repeat(np.arange(len(words)), sizes)
        for a in range(0, len(data), BLOCK):
            b, front = min(a + BLOCK, len(data)), min(a, self.order)
            cost = self._coded(data[a - front : b], local[a - front : b])[front:]
            first, last = owner[a], owner[b - 1]
            ends = np.searchsorted(owner[a:b], np.arange(first, last + 2))
            out[first : last + 1] += segment_sums(cost, ends)
        return out

    def _coded(self, data: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Bits of every byte behind the bytes in front of it; the blank in front of a word is free."""
        cost = np.zeros((len(data), len(self.languages)))
        open_at = np.flatnonzero(local > 0)
        rolls = rolled(data, self.order + 1)
        for k in range(self.order, -1, -1):
            deep = local[open_at] >= k
            at = open_at[deep]
            keys = rolls[k][at]
            known, rows = self.grams[k].find(keys)
            cost[at[known]] += self.grams[k].bits[rows]
            rest = at[~known]
            met, rows = self.contexts[k].find(keys[~known] >> 8)
            cost[rest[met]] += self.contexts[k].bits[rows]
            open_at = np.concatenate([open_at[~deep], rest])
        cost[open_at] += self.uniform
        return cost


class Scorer:
    """Code lengths of texts, with a bounded memory of words. Made anew for each partition."""

    def __init__(self, trees: Trees, cached: int = CACHED_WORDS):
        self.trees, self.cached = trees, cached
        self._clear()

    def _clear(self) -> None:
        self.known = Vocabulary()
        self.rows = np.zeros((1024, len(self.trees.languages) + 2))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per text and language, and letter runs and coded bytes per text."""
        if len(self.known.words) > self.cached:
            self._clear()
        words, starts = split_words(texts)
        first = len(self.known.words)
        number, new = self.known.numbers(words)
        if len(new):
            self._learn(first, new.to_pylist())
        both = segment_sums(self.rows[number], starts)
        return both[:, :-2], np.rint(both[:, -2]), np.rint(both[:, -1])

    def _learn(self, first: int, words: list[str]) -> None:
        """Letter runs of all new words are coded together."""
        lists = [LETTERS.findall(w) for w in "\n".join(words).lower().split("\n")]
        parts = [p.encode() for x in lists for p in x]
        sizes = np.array([len(p) + 1 for p in parts], float)[:, None]
        coded = np.column_stack([self.trees.bits(parts), np.ones(len(parts)), sizes]) if parts else np.zeros((0, self.rows.shape[1]))
        last = first + len(words)
        if last > len(self.rows):
            grown = np.zeros((max(last, 2 * len(self.rows)), self.rows.shape[1]))
            grown[:first] = self.rows[:first]
            self.rows = grown
        self.rows[first:last] = segment_sums(coded, np.cumsum([0, *map(len, lists)]))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS, limits: bool = False) -> Trees:
    """Trees from a bounded sample of the labelled rows that are not held out.

    With `limits` one in `CHECKED` texts is kept back, and the trees know how many
    bits a byte of text of each language takes that they have not learned from.
    """
    sample = learning_sample(docs, "lang", crc_residue() != 2, per_language, sample_chars)
    if not limits:
        return Trees([(r.label, r.word, r.n) for r in word_counts(sample).orderBy("label", "word").collect()])
    prepare(docs.sparkSession)
    sample = saved(sample.withColumn("back", F.pmod(F.xxhash64("text"), F.lit(CHECKED)) == 0), "language-sample")
    trees = Trees([(r.label, r.word, r.n) for r in word_counts(sample.where("not back")).orderBy("label", "word").collect()])
    back = predict(sample.where("back"), trees, keep=("label",))
    own = back.where(F.col("lang_pred") == F.col("kept_label"))
    found = {r.lang_pred: (r.mean, r.spread or 0.0) for r in own.groupBy("lang_pred").agg(F.avg("rate").alias("mean"), F.stddev("rate").alias("spread")).collect()}
    trees.limits = [ALLOWED * (found[x][0] + DEVIATIONS * found[x][1]) if x in found else trees.uniform for x in trees.languages]
    return trees


def predict(docs: DataFrame, trees: Trees, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rate (bits a byte in that language), fits
    (whether it stays within the limit of the language, if the trees know one), and
    the columns `keep` as they are: text by its name, others with `kept_` in front."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(trees)
    held = F.coalesce(crc_residue() == 2, F.lit(False)).alias("held_out")
    rows = docs.select("doc_id", held, F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep if c != "text"])
    dropped = [] if "text" in keep else ["text"]
    out = rows.drop(*dropped).schema.add("lang_pred", "string").add("score", "double").add("rate", "double").add("fits", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        scorer = Scorer(trees)
        limits = np.array(trees.limits or [np.inf] * len(trees.languages))
        for batch in (part for whole in batches for part in in_slices(whole)):
            n = batch.num_rows
            names, scores, rates, fits = [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.zeros(n, bool)
            if trees.languages:
                bits, runs, coded = scorer(batch.column("text"))
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(best)), best]
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                names = [trees.languages[b] if r else UNKNOWN for b, r in zip(best, runs, strict=True)]
                scores = np.where(runs > 0, share, 0.0)
                rates = least / np.maximum(coded, 1)
                # Of a short text the mean over its bytes says less.
                fits = (runs > 0) & (rates <= limits[best] * (1 + SHORT / np.maximum(coded, 1)))
            rest = batch.drop_columns(dropped)
            columns = [*rest.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64()), pa.array(fits)]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest.schema.names, "lang_pred", "score", "rate", "fits"])

    return rows.mapInArrow(run, out)
