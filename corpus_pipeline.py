"""Corpus preparation: language ID, line dedup, near-dedup, decontamination, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from noveltybench.llm import byte_bpe, decontam, language, line_templates, near_dup
from noveltybench.llm.storage import stored


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Arrow batches of ``rows`` texts at most, for this session.

    Each of an executor's tasks holds a batch in either direction beside the heap, and after the joins of one stage the
    heap of a long-running executor leaves little room for the next stage's batches of the usual 10,000 rows.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in none of the labelled languages, go; ``lang`` becomes the language found.

    A null text goes; without labelled rows all documents go; repeated rows are answered alike.
    """
    small_batches(spark)
    return language.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents are dropped from all but the first; emptied documents go.

    Null and empty texts stay as they are, and so do documents with a null id.
    """
    small_batches(spark)
    return line_templates.drop_recurring(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: that of the smallest id.

    Null and word-less texts and null ids are in no group and stay; rows that repeat a kept id stay with it.
    """
    small_batches(spark)
    return near_dup.keep_one(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Null and word-less texts stay; an empty benchmark removes nothing.
    """
    small_batches(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mode="document")


def byte_bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of what they decode to; a null text has no ids."""
    small_batches(spark)
    kept = docs.select("doc_id", "lang", "source", "text")
    return byte_bpe.encode(kept, public_tokenizers.path("byte_bpe_50k.json"), round_trip=True).drop("text")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe_ids),
]

#: Language ID and BPE can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
