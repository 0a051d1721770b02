"""A corpus pipeline of text operators: each stage works on all that the one before kept.

Language identification and the quality classifier learn from the labelled rows
of their own input that are not held out, and drop what they reject. Near
duplicates leave the smallest doc_id of each group. Repeated byte strings then
leave the texts, and packing turns these into sequences of token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tickloom.llm import language_id, line_crf, minhash, packing, suffix_array
from tickloom.session import fresh_dir

# Below this share another learned language is as likely, and the document is rejected.
LANGUAGE_SHARE = 0.5
SHINGLE_WORDS = 5


def _columns(df: DataFrame, names: list[str]) -> list:
    return [(F.col("text") if c == "text" else F.col(f"kept_{c}")).alias(c) for c in names]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, in a learned language, and clear which."""
    told = language_id.predict(docs, language_id.fit(docs, limits=True), keep=tuple(docs.columns))
    clear = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LANGUAGE_SHARE) & F.col("fits")
    return told.filter(clear).select(*_columns(told, docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good."""
    field = line_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    told = line_crf.predict(docs, field, keep=tuple(docs.columns))
    return told.filter(F.col("predicted") == 1).select(*_columns(told, docs.columns))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group; of rows with one doc_id the first by text.

    Rows without an id are groups of their own. Only rows whose id is repeated
    are gathered by it, with a part of the sum in each task.
    """
    gone = minhash.near_duplicates(docs, SHINGLE_WORDS).filter(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    least = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col("text").isNotNull(), F.col("text")))
    first = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(least.alias("row"))
    once = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(first.select("row.*"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur again elsewhere."""
    kept = suffix_array.dedup_texts(docs, keep=tuple(c for c in docs.columns if c != "text"))
    left = kept.select(*_columns(kept, docs.columns))
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, each a power of two long."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near-duplicates", without_near_duplicates),
    ("repeats", without_repeats),
    ("packing", packed),
]

# Tokenizers and trained models are beyond SQL; tests hold the rows against a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
