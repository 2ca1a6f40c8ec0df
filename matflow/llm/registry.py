"""The op queries of the subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matflow.llm import (chat, decontaminate, divergence, exactdedup, language, mixing, sanitise, simhash, substrings,
                         tokens, toxicity, variants, warc)
from matflow.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


@_query("op1_warc_revisits", warc.ORACLE)
def op1(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"))


@_query("op2_sanitise")
def op2(spark, sf_dir):
    return sanitise.sanitise(table(spark, sf_dir, "documents"), texts=False)


@_query("op3_language_cnn")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language.fit(language.training_pieces(docs))
    return language.with_language(docs, net).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"),
        F.col("language.lang").alias("lang_pred"), "language.score")


@_query("op4_mixing")
def op4(spark, sf_dir):
    out, *_ = mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_tokens",
                      *[F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)],
                      "rate", "copies")


@_query("op5_token_binary")
def op5(spark, sf_dir):
    return tokens.tokenize(table(spark, sf_dir, "documents"))


@_query("op6_chat_repair")
def op6(spark, sf_dir):
    return chat.repair(table(spark, sf_dir, "conversations"))


@_query("op7_toxicity_mil")
def op7(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.training_rows(docs, labels, held_out=toxicity.held_out(F.col("doc_id"))))
    return (toxicity.score(docs, model)
            .select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"))


@_query("op8_simhash_near_dedup")
def op8(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@_query("op9_decontaminate")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        decontaminate.digest_items(F.col("found.items")).alias("items_sha256"), "contaminated")


@_query("op10_exact_dedup", exactdedup.ORACLE)
def op10(spark, sf_dir):
    return exactdedup.deduplicate(table(spark, sf_dir, "documents"))


@_query("op11_spelling_variants", variants.ORACLE)
def op11(spark, sf_dir):
    return variants.group_variants(table(spark, sf_dir, "documents"))


@_query("op12_source_divergence", divergence.ORACLE)
def op12(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


@_query("op13_substring_dedup", substrings.ORACLE)
def op13(spark, sf_dir):
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
