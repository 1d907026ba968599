"""From raw documents to token ids: five stages, each an operator applied to what the one before
has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgauge.llm.curriculum_mix import mixed_documents
from marketgauge.llm.parity_join import survivors
from marketgauge.llm.piece_codec import encode_pieces
from marketgauge.llm.quality_cascade import quality_cascade
from marketgauge.llm.secret_scan import redact
from marketgauge.llm.texts import spare
from marketgauge.session import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule."""
    kept = spare(docs, "_kept")[0]
    return quality_cascade(docs, name=kept).filter(kept).drop(kept)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id."""
    return survivors(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a tag."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix reads them, in training order."""
    return mixed_documents(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the end id, and whether decoding them gives the text again."""
    return encode_pieces(
        docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"),
        {"n_tokens": lambda e: e.n_tokens, "ids": lambda e: e.numbers,
         "round_trip": lambda e: e.decoded == e.text},
        {"n_tokens": "bigint", "ids": "array<int>", "round_trip": "boolean"}, drop=("text",))


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard_join", ngram_jaccard_join),
          ("secret_scans", secret_scans), ("source_mix", source_mix), ("piece_ids", piece_ids)]

# SentencePiece merges can't be told in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
