"""Packing by power-of-two decomposition.

A document of n ids becomes floor(n / longest) pieces of the longest length and
one piece for every binary digit of the rest. Each piece is a sequence of its
own whose length is a power of two, so no sequence crosses documents and none
is padded; sequences of equal length share a bucket and can be batched.

Ids come from a tokenizer that drops white space, so a batch of texts is encoded
by its distinct words: each task numbers the words it meets, in a bounded table,
the library encodes the new ones together, and the ids of all texts are gathered
from there at once. Pieces are cut on offsets into them.

Defined cases: a null or empty text is only its end id; rows with a null or
repeated doc_id are packed like any other; a text that spells out an added token
of the tokenizer is encoded by the library as a whole, which gives that token's
id; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import SLICE_BYTES, Vocabulary, in_slices, prepare, split_words, texts

LONGEST = 4096
END_ID = 2
CACHED_WORDS = 500_000

# Letters with one lower case of one character, and marks behind them: two runs at most that no word is cut within.
PLAIN_WORD = r"^(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]*)(?P<marks>[!-/:-@\[-`{-~]*)$"
JOINED = 1000
WORD_END = "</w>"


class WordEncoder:
    """Ids of many texts at once. Words get numbers; their ids lie behind each other in one array."""

    def __init__(self, tokenizer_file: str, cached: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A text that spells an added token is cut by the library, not word by word.
        self.special = "|".join(map(re.escape, added))
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.cached = cached
        self._clear()

    def _clear(self) -> None:
        self.known = Vocabulary()
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text followed by `end_id`, and where each text begins (one more for the end)."""
        if len(self.known.words) > self.cached:
            self._clear()
        texts, n = texts.fill_null(""), len(texts)
        whole: dict[int, np.ndarray] = {}
        if self.special:
            spelled = pc.match_substring_regex(texts, self.special)
            for i in np.flatnonzero(spelled.to_numpy(zero_copy_only=False)).tolist():
                whole[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            texts = pc.if_else(spelled, "", texts)
        words, first_word = split_words(texts)
        number, new = self.known.numbers(words)
        if len(new):
            self._learn(new)
        first, size = self.ends[number], self.ends[number + 1] - self.ends[number]
        word_ends = np.concatenate([[0], np.cumsum(size)])
        own = word_ends[first_word[1:]] - word_ends[first_word[:-1]]
        lengths = own + 1
        for i, ids in whole.items():
            lengths[i] += len(ids)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        out = np.full(starts[-1], end_id, np.uint32)
        # Ids go behind those of the words before, and each text is moved on by what texts before it have more.
        every = np.arange(word_ends[-1])
        out[every + np.repeat(starts[:-1] - word_ends[first_word[:-1]], own)] = self.ids[every + np.repeat(first - word_ends[:-1], size)]
        for i, ids in whole.items():
            out[starts[i] : starts[i] + len(ids)] = ids
        return out, starts

    def _learn(self, words: pa.Array) -> None:
        """Ids of new words. Most are letters and marks behind them, of which the letters
        repeat with other marks and in other cases; those are encoded once."""
        halves = pc.extract_regex(words, PLAIN_WORD)
        plain = halves.is_valid().to_numpy(zero_copy_only=False)
        odd = words.filter(pa.array(~plain)).to_pylist()
        letters, marks = pc.utf8_lower(pc.struct_field(halves, "letters")), pc.struct_field(halves, "marks")
        # Each word is two parts. The second of an odd word is empty.
        pairs = np.zeros((len(words), 2), np.int64)
        both = pa.concat_arrays([letters.filter(pa.array(plain)), marks.filter(pa.array(plain)), pa.array([""])])
        coded = both.dictionary_encode()
        ids, ends = self._parts(coded.dictionary.to_pylist())
        odd_ids, odd_ends = self._words(odd)
        at = coded.indices.to_numpy(zero_copy_only=False)
        pairs[plain] = at[:-1].reshape(2, -1).T
        pairs[~plain, 0] = len(ends) - 1 + np.arange(len(odd))
        pairs[~plain, 1] = at[-1]
        pairs = pairs.ravel()
        ids, ends = np.concatenate([ids, odd_ids]), np.concatenate([ends, ends[-1] + odd_ends[1:]])
        size = ends[pairs + 1] - ends[pairs]
        source = np.repeat(ends[pairs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size.reshape(-1, 2).sum(axis=1))])
        self.ids = np.concatenate([self.ids, ids[source]])

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of letters or marks (one may be empty), which the tokenizer does
        not cut: each ends with a token that ends a word."""
        filled = [x for x in parts if x]
        joined = [" ".join(filled[i : i + JOINED]) for i in range(0, len(filled), JOINED)]
        coded = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *[np.array(x.ids, np.uint32) for x in coded]])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(filled):  # a tokenizer without such tokens
            return self._words(parts)
        sizes = np.zeros(len(parts), np.int64)
        sizes[[i for i, x in enumerate(parts) if x]] = np.diff(ends, prepend=0)
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words; a token belongs to the word it starts in."""
        encoding = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ends = np.cumsum([len(w) + 1 for w in words])
        owner = np.searchsorted(ends, np.array([a for a, _ in encoding.offsets], np.int64), "right")
        sizes = np.bincount(owner, minlength=len(words))[: len(words)]
        return np.array(encoding.ids, np.uint32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def pieces_of(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text, start and length of every piece: full ones, then the binary digits of the rest from the highest."""
    full, rest = lengths // longest, lengths % longest
    digits = 1 << np.arange(longest.bit_length() - 2, -1, -1, dtype=np.int64)
    text, digit = np.nonzero(rest[:, None] & digits)
    owner = np.concatenate([np.repeat(np.arange(len(lengths)), full), text])
    size = np.concatenate([np.full(full.sum(), longest, np.int64), digits[digit]])
    order = np.argsort(owner, kind="stable")
    owner, size = owner[order], size[order]
    behind = np.cumsum(size) - size
    begin = np.cumsum(lengths) - lengths
    return owner, behind - begin[owner], size


def pack_documents(docs: DataFrame, tokenizer_file: str, longest: int = LONGEST, end_id: int = END_ID, digest: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket (its length as
    a power of two), sequence_id, offset and its ids, or their crc32 with `digest`.

    `longest` has to be a power of two. Sequence ids are unique, not dense.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest has to be a power of two")
    prepare(docs.sparkSession)
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int32()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_file)
        for batch in (part for whole in batches for part in in_slices(whole, 2 * SLICE_BYTES)):
            ids, starts = encoder.encode(batch.column("text"), end_id)
            lengths = np.diff(starts)
            owner, start, size = pieces_of(lengths, longest)
            at = starts[owner] + start
            if digest:
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                value = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)], pa.int64())
            else:
                value = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))
            doc = batch.column("doc_id").take(pa.array(owner))
            numbers = [pa.array(x, pa.int64()) for x in (start, size, lengths[owner])]
            yield pa.RecordBatch.from_arrays([doc, *numbers, value], schema=schema)

    kind = "ids_crc32 long" if digest else "ids array<int>"
    pieces = texts(docs).mapInArrow(run, f"doc_id long, start long, length long, doc_tokens long, {kind}")
    return pieces.select(
        "*",
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder of sequences per length; large buckets are spread over files."""
    pieces.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
