"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltion.llm import bpe, decontaminate, simhash, suffix_dedup, toxicity
from deltion.llm.shared import free_name, settle, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (8): documents that it rejects go; learned from the labels of the documents at hand. Null and empty texts stay."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (3): the document with the smallest id of each group stays. Null and empty texts are one group."""
    return simhash.one_of_each(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup (7): runs of 100 bytes that start earlier go, and documents that have nothing else.

    Null and blank texts stay as they are; equal rows lose the same.
    """
    blank = free_name(docs.columns, "blank")
    marked = docs.withColumn(blank, F.coalesce(F.trim("text") == "", F.lit(True)))
    left = suffix_dedup.without_spans(marked, suffix_dedup.repeated_spans(docs, length=100))
    left = left.where(F.col(blank) | (F.trim("text") != "")).drop(blank)
    return left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (5): documents that hold an item go. Null and empty texts hold none."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding (10): the ids of what is left, with the digests of ids and decoded text. A null text is empty."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [("toxicity", clean), ("simhash", distinct), ("suffix_array", unrepeated), ("decontamination", uncontaminated), ("bpe", encoded)]

#: The classifier, the retrieval and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Null and empty texts pass; rows that are there twice stay once."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
