"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. language_id: texts without a recognisable language go.
2. near_dedup: of each group of near-duplicates one document stays.
3. decontamination: documents that hold a benchmark passage go.
4. mixing: sources are brought to their target weights; a document comes as often as it is taken.
5. token_output: the mixed corpus is tokenised and written; the result describes the files' documents.

Defined cases: a null text, or one without letters, has no language and goes at the first stage, unless nothing is labelled
and no model exists, when all rows stay; null labels and sources are values like any other (documents without a source are one
source, the last); a null id is kept and names no group of near-duplicates unless all its ids are null; repeated rows are
near-duplicates of each other, so one stays, and what mixing takes more than once comes as often; very long texts go through
whole; ties are broken as each stage says; an empty table gives an empty result; further columns, also of names that a stage
uses within, are carried to the last stage unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillsift.llm import decontam, langid, mixing, near_dedup, token_output
from quillsift.llm.common import documents, staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.train(docs))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.token_table(docs, "byte_bpe_50k.json", end=2)


STAGES = [("language_id", language_id), ("near_dedup", dedup), ("decontamination", decontamination), ("mixing", mix), ("token_output", tokens)]

#: SQL cannot express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of a folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
