"""The registered queries of the subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embed_dedup, mixing, ngram_join, packing, pii, quality, sharding, suffix_dedup, token_counts, toxicity
from .common import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(read_table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.digest(read_table(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read_table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(read_table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(read_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read_table(spark, sf_dir, "documents"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(read_table(spark, sf_dir, "documents"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_embedding_dedup, op3_mix_sources, op4_ngram_join, op5_personal_data, op6_toxicity, op7_token_counts, op8_suffix_dedup, op9_pack, op10_shard)}


def oracle_sql() -> dict:
    return {"op1_quality_rules": quality.oracle(), "op2_embedding_dedup": embed_dedup.oracle(), "op3_mix_sources": mixing.oracle(), "op4_ngram_join": ngram_join.oracle()}
