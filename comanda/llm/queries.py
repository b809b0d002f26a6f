"""Registered queries of the training-data operators, with oracle SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comanda.llm import ball_kmeans, decontamination, exact_dedup, fingerprints, ngram_join, quality, source_mixing, suffix_dedup, surrogates, token_alignment, token_binary, toxicity, url_filters
from comanda.llm.common import table
from comanda.llm.oracle import ORACLE_SQL  # noqa: F401

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
N_VOCAB, END_ID = 49_408, 1
ALIGNED = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Of the registered query alone; the operator has no key of its own.
DEMONSTRATION_KEY = "demonstration"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_copies", "n_links")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = source_mixing.taken_words(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), with_bytes=False)
    return kept.drop("kept")


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_binary.write_shards(docs, TOKENIZER, N_VOCAB, END_ID)
    return token_binary.read_digests(manifest)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.judged(table(spark, sf_dir, "documents"), DEMONSTRATION_KEY)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(pages, url_filters.spam_list(pages))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.judged(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(table(spark, sf_dir, "documents"), *ALIGNED)


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.judged(table(spark, sf_dir, "embeddings"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, source_size and target of every source of op4_source_mixing."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("source", source_mixing.n_words(F.col("text")).alias("size"))
    return source_mixing.targets(sized).select("source", "source_size", F.round("target", 3).alias("target"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars and edited_sha256 of op8_fingerprints: its part that SQL can tell."""
    return fingerprints.edited(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_source_mixing": op4_source_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_binary": op6_token_binary,
    "op7_surrogates": op7_surrogates,
    "op8_fingerprints": op8_fingerprints,
    "op9_url_filters": op9_url_filters,
    "op10_decontamination": op10_decontamination,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_ball_kmeans": op13_ball_kmeans,
    "mixing_targets": mixing_targets,
    "fingerprint_edits": fingerprint_edits,
}
