"""The queries of this package: each applies an operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .curriculum_mix import curriculum_mix
from .language_id import fit_languages, fold_of, predict_languages
from .lexical_search import ranked_search
from .line_dedup import dedup_lines
from .merkle_fingerprints import edit_fingerprints
from .parity_join import near_duplicates
from .periodic_runs import find_runs
from .piece_codec import encode_pieces
from .quality_cascade import quality_cascade
from .secret_scan import KINDS, described, scan_secrets
from .stratified_shards import stratified_shards
from .suffix_dedup import remove_repeats
from .texts import WORD, documents, whole_text
from .token_counts import count_tokens

LIMIT = 512


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op1_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_cascade(documents(spark, sf_dir).select("doc_id", "text"), measures=MEASURES)
    return judged.select("doc_id", *MEASURES, "kept")


def op2_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(whole_text(), "UTF-8")
    rows = documents(spark, sf_dir).select(
        "doc_id", "source", (F.octet_length(whole_text()) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    placed = stratified_shards(rows, ties=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "source", "text",
                                           F.md5(whole_text()).alias("content"))
    mixed = curriculum_mix(rows, ties=("content",))
    first = F.get("readings", F.lit(0))["position"]
    return (mixed.select("doc_id", "size", "source_size", "target", "taken",
                         F.round(first, 9).alias("position"))
            .orderBy("position", "doc_id"))


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
        "near_next")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(
        documents(spark, sf_dir).select("doc_id", "text"),
        public_tokenizers.path("piece_bpe_32k.model"),
        {"n_tokens": lambda e: e.n_tokens, "ids_sha256": lambda e: sha256(e.ids),
         "decoded_sha256": lambda e: sha256(e.decoded)},
        {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        drop=("text",))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}")
              for k in KINDS[:3]]
    base = F.filter("secrets", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *counts, F.sha2(described(base), 256).alias("base_sha256"),
                        described(F.col("secrets")).alias("spans"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_languages(docs.filter(fold_of("doc_id") != 0))
    found = predict_languages(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    kept = F.sha2(whole_text("kept"), 256).alias("kept_sha256")
    return out.select("doc_id", "n_lines", "n_dropped", kept)


def with_repeats(docs: DataFrame) -> DataFrame:
    """Every tenth text (by a checksum of doc_id) goes on from one of its words with a part that
    repeats; its words are joined by blanks."""
    h = F.crc32(F.col("doc_id").cast("string"))
    marked = docs.select("doc_id", "text", (h % 10 == 0).alias("changed"), F.floor(h / 10).alias(
        "g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), 0)).alias("words"))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    unit = F.slice("words", a + 1, p)
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), n - a)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), a), tail), " ")
    return marked.select("doc_id", F.when(F.col("changed") & (n > 0), text).otherwise(
        F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_repeats(documents(spark, sf_dir)))
    # Greatest length, then smallest start, then smallest period.
    best = F.reduce("runs", F.lit(None).cast(found.schema["runs"].dataType.elementType),
                    lambda b, r: F.when(b.isNull() | (r["length"] > b["length"]), r).otherwise(b))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")),
        F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                       F.sha2(told, 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                      milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked_search(documents(spark, sf_dir), items)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_cascade, op2_stratified_shards, op3_curriculum_mix, op4_merkle_fingerprints,
    op5_piece_codec, op6_token_counts, op7_parity_join,
    op8_suffix_dedup, op9_secret_scan, op10_language_id, op11_line_dedup,
    op12_periodic_runs, op13_lexical_search)}
