"""A training-data pipeline over ``documents``: five stages of the operators in veriframe.llm.

Defined results: documents without words go in the first stage, as the rules have
it, or in the second, which may take all their lines; of repeated rows one stays;
very long texts are taken whole; a null doc_id, lang or source is a value like
others; further columns come through the first four stages; empty tables give
empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm import bpe_replay, decontaminate, jaccard_join, line_dedup, quality_rules
from veriframe.llm.common import documents, fresh, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their language's perplexity band go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any number of words that match an earlier line go; so do documents that have no word left."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return jaccard_join.distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean_documents(docs, documents(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether decoding gives back the text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe_replay.encode(docs, path, decoded=fresh(docs, "decoded"))
    return decoded.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col(fresh(docs, "decoded")) == F.encode("text", "utf-8")).alias("round_trip"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: SQL can't express the perplexity model; tests/llm/test_pipeline.py compares the chain with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir))
    return docs
