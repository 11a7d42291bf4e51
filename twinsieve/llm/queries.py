"""The corpus queries: each applies one operator, with its usual parameters, to its whole table.

What nulls in any column, empty and very long texts, ties, repeated rows, empty tables
and further columns of clashing names give is what the operator's docstring says; a
query adds no rule to it but the choice of its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinsieve.llm import decontaminate, embed_hnsw, html_gbt, langid, minhash, packing, secrets_crf, slots, toxicity, warc
from twinsieve.llm.oracle import SQL
from twinsieve.llm.shared import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, hash and spans of every document; a null text is empty."""
    return secrets_crf.digest(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null html gives an empty text."""
    return html_gbt.extract(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are inside benchmark windows; null texts and items have no words."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; null texts and those without a letter are ``und``."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by shared 4-word shingles; texts without words are alone."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, empty and null texts too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.rate_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors; null, zero and non-finite vectors are alone."""
    return embed_hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; null html is an empty payload."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard by the law ``bytes``; equal texts are groups, a null text has no bytes."""
    return slots.shard_documents(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 1024 tokens; a null or empty text is the end id."""
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return SQL
