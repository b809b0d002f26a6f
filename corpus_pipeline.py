"""A training corpus from raw documents: five stages, each written and read again.

The fourth stage writes the mix in the order of its slots, stretch by stretch; the fifth takes that order
from the files it reads, so neighbouring tokens are of the sources that the schedule puts side by side.

Defined cases: empty tables give no rows; null texts and doc_ids and repeated rows are documents each,
as the operators' docstrings tell, and no stage drops a clean document for them (the near duplicates
keep one of several, the mix takes none without words); further columns pass through until the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from comanda.llm import decontamination, ngram_join, queries, source_mixing, token_binary, toxicity
from comanda.llm.common import in_file_order, table
from comanda.session import written


def no_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.first_of_groups(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mix; a row for each document read back from them."""
    placed, order = in_file_order(docs)
    return token_binary.read_digests(token_binary.write_shards(placed, queries.TOKENIZER, queries.N_VOCAB, queries.END_ID, order=order))


STAGES = [
    ("toxicity", no_toxic),
    ("ngram_join", no_near_duplicates),
    ("decontamination", no_benchmark),
    ("source_mixing", mixed),
    ("token_binary", tokens),
]

#: A trained classifier and MinHash are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
