"""Corpus pipeline: language ID, near-duplicate removal, benchmark
decontamination, mixing to target weights, token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next stage's docs; all but the last return the
columns of documents. No stage has a SQL form (``ORACLE_SQL`` is None): each is
tested against a brute-force version of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matflow.llm import decontaminate, language, mixing, simhash, tokens
from matflow.llm.common import shared_table, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts of no learned language."""
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component (4-word shingles, 4 bits)."""
    return simhash.keep_one(docs, words=4, distance=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents and cut benchmark passages from the others."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents by their rates (default targets)."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write Simple-8b token files; one row per document read back from them."""
    return tokens.tokenize(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
    ("token_files", token_files),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
