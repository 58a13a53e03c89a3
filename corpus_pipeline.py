"""A corpus prepared for training: five stages, each applying one operator to what the last one kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm import decontam, langid, pieces, simhash, suffixes
from shelfmark.scratch import pin

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# A text of which no learned language has this share of n-grams is rejected.
LEAST_LANGUAGE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without letters and texts in none of the languages that the rows name."""
    model = langid.learn(docs.select("lang", "text"))
    found = langid.identify(docs, model, carry=True)
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)
    return found.filter(sure).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group that SimHash words propose and four fifths of the shingles confirm."""
    return simhash.one_of_each(docs, simhash.near_copies(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated strings of 100 bytes out of every text but the first; a text with nothing left goes."""
    left = suffixes.without_repeats(docs, characters=True, carry=True)
    left = left.filter((F.octet_length("kept") > 0) | (F.col("n_bytes") == 0))
    text = F.decode("kept", "UTF-8")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return left.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = pin(decontam.contaminated(docs, benchmark).select("doc_id", "text_hash").distinct(), "leaks")
    found = found.select(F.col("doc_id").alias("_leak"), F.col("text_hash").alias("_leak_hash"))
    own_hash = F.xxhash64(F.col("text").cast("string"))
    match = F.col("doc_id").eqNullSafe(F.col("_leak")) & (own_hash == F.col("_leak_hash"))
    return docs.join(found, match, "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with digests of the ids and of the text decoded from them."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_documents(docs, model, with_ids=True, with_decoded=False)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", tokens),
]

# Several stages (fingerprints, suffix order, pieces) have no SQL form; tests compare them with
# brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
