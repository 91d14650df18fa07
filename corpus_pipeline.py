"""From raw documents to packed training sequences, in stages written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivetgraph.llm import mixture_packing, ngram_join, repeated_passages, secrets, toxicity
from rivetgraph.llm.common import table
from rivetgraph.llm.queries import byte_bpe
from rivetgraph.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay where they first occur only."""
    return repeated_passages.remove_repeats(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, sources mixed in proportion."""
    return mixture_packing.pack_report(docs, *byte_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", keep_one_of_each_group),
    ("repeated_passages", drop_repeated_passages),
    ("secrets", hide_secrets),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else cut(docs)
    return docs
