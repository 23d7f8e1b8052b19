"""From raw documents to a mixed, tokenised corpus: five stages, each a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leakaudit.llm import bpe, mixing, near_dedup, quality_rules, suffix_dedup
from leakaudit.llm.common import documents, scratch
from leakaudit.llm.queries import TOKENIZER


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs, length="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, TOKENIZER, with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

ORACLE_SQL = None  # SQL can't express near-duplicate groups by signatures or BPE


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
