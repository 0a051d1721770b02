"""Byte-level BPE with a local rank file: encode whole texts, decode to bytes.

The tiktoken library does the encoding. Its regular expression engine keeps a
stack per match, so a long text is cut beforehand, only where no match of the
pattern can reach across: in front of white space that follows something else.
A run of white space longer than a piece is a match by itself (but for its last
character, if text follows) and is encoded without the pattern.

Defined cases: a null or empty text has no ids and decodes to no bytes; rows
with a null or repeated doc_id are encoded like any other, one result per row;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from tickloom.llm.common import prepare, record, texts, values_of

PIECE_CHARS = 16_384
SPACE = regex.compile(r"\p{White_Space}")
SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")
LONG_SPACE = regex.compile(rf"\p{{White_Space}}{{{PIECE_CHARS},}}")


class Codec:
    def __init__(self, rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.split = tiktoken.Encoding("split", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.piece_chars = piece_chars

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.piece_chars:
            return self.split.encode_ordinary(text)
        ids: list[int] = []
        at = 0
        for run in LONG_SPACE.finditer(text):
            ids += self._stretch(text[at : run.start()])
            at = run.end() if run.end() == len(text) else run.end() - 1
            ids += self.whole.encode_ordinary(text[run.start() : at])
        return ids + self._stretch(text[at:])

    def _stretch(self, text: str) -> list[int]:
        """Text without very long white space, in pieces."""
        ids: list[int] = []
        at = 0
        while at < len(text):
            cut = SAFE.search(text, at + self.piece_chars) if len(text) - at > self.piece_chars else None
            end = cut.start() if cut else len(text)
            ids += self.split.encode_ordinary(text[at:end])
            at = end
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.split.decode_bytes(ids)


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every text."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(rank_file, pattern)
        for doc_ids, bodies in values_of(batches, "doc_id", "text"):
            yield record(schema, doc_ids, [coder.encode(t or "") for t in bodies])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, bytes (binary) of every list of ids; a null list gives no bytes."""
    prepare(tokens.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(rank_file, pattern)
        for doc_ids, ids in values_of(batches, "doc_id", "ids"):
            yield record(schema, doc_ids, [coder.decode(x or []) for x in ids])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Encode and decode every text in one pass; ids and bytes leave as digests."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(rank_file, pattern)
        for doc_ids, bodies in values_of(batches, "doc_id", "text"):
            counts, packed, decoded = [], [], []
            for text in bodies:
                ids = coder.encode(text or "")
                counts.append(len(ids))
                packed.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield record(schema, doc_ids, counts, packed, decoded)

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
