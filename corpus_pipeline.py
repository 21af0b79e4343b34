"""From raw documents to packed training sequences: five operators, each over all that the one before kept.

1. quality: documents that the adaptive rules reject go.
2. near_duplicates: one document of each class of five-word Jaccard similarity 0.8 stays.
3. personal_data: spans of personal data give way to their kind in brackets.
4. mix: sources are mixed to their target weights; a document appears once for each reading.
5. pack: texts become pieces of sequences of 2048 tokens.

Stages 1 to 4 return the columns of documents. Null texts fail the quality rules; each operator's
module defines its other cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeworks.llm import mixing, ngram_join, packing, pii, quality
from lodeworks.llm.common import materialize, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, ngram_join.JoinParams(words=5, numerator=8, denominator=10))


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", duplicates_stage),
    ("personal_data", personal_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

#: Language, the BPE vocabulary and the bootstrapping have no SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
