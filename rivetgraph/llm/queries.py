"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rivetgraph.llm import (
    chat_formatting,
    divergence_rules,
    importance_resampling,
    language_evidence,
    mixture_packing,
    ngram_join,
    piece_viterbi,
    repeated_passages,
    secrets,
    source_divergence,
    surrogates,
    toxicity,
    vector_graph,
)
from rivetgraph.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> tuple[str, str]:
    """The byte-level vocabulary's file, and the same as ranks."""
    return tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_language_evidence")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_evidence.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op3_divergence_rules", divergence_rules.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules.judge(table(spark, sf_dir, "documents"))


@query("op4_vector_graph")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op5_piece_viterbi")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_viterbi.encode_report(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op6_mixture_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packing.pack_report(table(spark, sf_dir, "documents"), *byte_bpe())


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@query("op8_ngram_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


@query("op9_repeated_passages")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.repeat_report(table(spark, sf_dir, "documents"))


@query("op10_surrogates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents"))


@query("op11_source_divergence", source_divergence.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_chat_formatting", chat_formatting.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_formatting.chat_report(chat_formatting.with_probe(table(spark, sf_dir, "conversations")))


@query("op13_importance_resampling", importance_resampling.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
