"""Byte-level BPE and packing against the libraries themselves."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tickloom.llm import byte_bpe, packing, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")

ODD_TEXTS = [
    None,
    "",
    " ",
    "a",
    "It's   they'll\n\n  go 123 ¼ — naïve ΣΑΣ İ ﬁ é́ \x1c\x1d x\x85y\xa0z w",
    "<|endoftext|> and <|startoftext|>",
    "日本語のテキスト 한국어 العربية 🙂🙂",
    "  leading and trailing \t\r\n",
    "ab" * 30_000,
    "x" + " " * 40_000 + "y",
    "x" + "\n" * 40_000,
    " " * 40_000,
    "word, " * 20_000 + "'s 'S can't",
]


def reference_encoding():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def every_match(text):
    whole = reference_encoding()
    return [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in whole.encode_ordinary(m)]


@pytest.mark.parametrize("text", ODD_TEXTS[1:])
def test_pieces_do_not_change_ids(text):
    coder = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    small = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN, piece_chars=7)
    ids = every_match(text)
    assert coder.encode(text) == ids
    if len(text) < 1000:
        assert small.encode(text) == ids
    assert coder.decode(ids) == text.encode()


def test_encode_decode_tables(documents):
    docs = documents([*enumerate(ODD_TEXTS), (None, "no id"), (3, "a")])
    tokens = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    got = sorted((repr(r.doc_id), bytes(r.bytes)) for r in byte_bpe.decode_documents(tokens, RANKS, public_tokenizers.PATTERN).collect())
    assert got == sorted((repr(r.doc_id), (r.text or "").encode()) for r in docs.collect())
    assert byte_bpe.encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_op10_round_trip(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_byte_bpe"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in rows:
        ids = every_match(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def held(tokenizer, docs, pieces, longest=packing.LONGEST):
    """Each id lies in exactly one piece, in order, and lengths are powers of two."""
    found = {}
    for p in pieces:
        assert p.length & (p.length - 1) == 0 and p.length <= longest and p.offset == 0
        found.setdefault(p.doc_id, []).append(p)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for doc_id, text in docs:
        ids = plain_ids(tokenizer, text)
        own = sorted(found.pop(doc_id), key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        at = 0
        for p in own:
            assert p.start == at
            at += p.length
            part = np.array(ids[p.start : at], "<u4")
            assert p.ids_crc32 == zlib.crc32(part.tobytes()) if hasattr(p, "ids_crc32") else p.ids == part.tolist()
    assert not found


def test_packing_odd_texts(documents):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = [*enumerate(ODD_TEXTS), (None, "no id")]
    held(tokenizer, rows, packing.pack_documents(documents(rows), WORDS, digest=True).collect())
    held(tokenizer, rows, packing.pack_documents(documents(rows), WORDS, longest=16).collect(), 16)
    assert packing.pack_documents(documents(rows).limit(0), WORDS).count() == 0
    twice = packing.pack_documents(documents([(1, "a b c"), (1, "a b c")]), WORDS).collect()
    assert sorted((p.start, p.length) for p in twice) == [(0, 4), (0, 4)]
    with pytest.raises(ValueError):
        packing.pack_documents(documents(rows), WORDS, longest=100)


def test_small_caches_do_not_change_ids():
    tokenizer = Tokenizer.from_file(WORDS)
    encoder = packing.WordEncoder(WORDS, cached=2)
    texts = [None, " lead", "tail\t", "ÀÉß ÿ's don't 's! ...a é", "<| <|endoftext|", "the quick brown fox, the lazy dog's tail. " * 30, "", "a <|endoftext|>b", "of the fox", "x\u3000y z"]
    for _ in range(3):
        ids, starts = encoder.encode(pa.array(texts), packing.END_ID)
        for text, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
            assert ids[a:b].tolist() == plain_ids(tokenizer, text)
    assert encoder.encode(pa.array([], pa.string()), packing.END_ID)[1].tolist() == [0]


def test_pieces_are_binary_digits():
    lengths = np.array([1, 4096, 4097, 8191, 3, 12288 + 6])
    owner, start, size = packing.pieces_of(lengths)
    for i, n in enumerate(lengths):
        own = [1 << b for b in range(11, -1, -1) if n % 4096 >> b & 1]
        assert size[owner == i].tolist() == [4096] * (n // 4096) + own
        assert start[owner == i].tolist() == [sum(size[owner == i][:j]) for j in range((owner == i).sum())]


def test_op1_packing(spark, sf_dir):
    tokenizer = Tokenizer.from_file(WORDS)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held(tokenizer, docs, queries.QUERIES["op1_packing"](spark, sf_dir).collect())


def test_buckets_are_written_by_length(documents, tmp_path, spark):
    pieces = packing.pack_documents(documents([(1, "a b c d e f"), (2, "a b")]), WORDS)
    packing.write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == pieces.count() and back.filter("length != pow(2, bucket)").count() == 0
