"""Registered queries of the training-corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from noveltybench.llm import byte_bpe, decontam, language, line_templates, near_dup, ogg, packed_ids, preference, quality, sql, token_alignment, toxicity, url_filter, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "documents"))


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digest(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.digest(table(spark, sf_dir, "documents"))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.digest(table(spark, sf_dir, "conversations"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.digest(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_near_dup,
        op2_language_id,
        op3_ogg_media,
        op4_decontamination,
        op5_line_templates,
        op6_preference_format,
        op7_byte_bpe,
        op8_packed_ids,
        op9_quality,
        op10_toxicity,
        op11_whitening,
        op12_token_alignment,
        op13_url_filter,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
