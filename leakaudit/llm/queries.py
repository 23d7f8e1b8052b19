"""The operators' queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakaudit.llm import bpe, chat, chunk_dedup, classifier, katz, mixing, near_dedup, neighbours, quality_rules, spelling, suffix_dedup, turn_trie, warc
from leakaudit.llm.common import documents, scratch

TOKENIZER = "byte_bpe_50k.json"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.mix_plan(documents(spark, sf_dir))
    return planned.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "times")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_groups(documents(spark, sf_dir), n=4, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return katz.score_texts(documents(spark, sf_dir), held_out).withColumnRenamed("id", "doc_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_report(documents(spark, sf_dir), n=200).withColumnRenamed("id", "doc_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "archives")
    warc.write_archives(documents(spark, sf_dir, "pages"), folder)
    found = warc.inventory(warc.reassemble(warc.read_records(spark, folder)))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "complete")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5 == 0
    weights = classifier.fit(docs, documents(spark, sf_dir, "labels").where(~held_out("doc_id")))
    scored = classifier.score(docs, weights)
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(documents(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), TOKENIZER).withColumnRenamed("id", "doc_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score_rules(documents(spark, sf_dir))
    return scored.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op10_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.preference(chat.answered_by_others(chat.conversations(documents(spark, sf_dir, "conversations"))))
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return made.select("id", "donor", "prompt_turns", "prompt", "chosen_text", "rejected_text", flat("chosen_spans").alias("chosen_spans"), flat("rejected_spans").alias("rejected_spans"), "usable")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_dedup.exact_groups(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = turn_trie.rebuilt(documents(spark, sf_dir, "conversations"), every=20, most=3)
    return turn_trie.prefix_trie(rebuilt).withColumnsRenamed({"id": "conv_id", "parent_id": "parent_conv_id"})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()}
