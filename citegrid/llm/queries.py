"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.llm import bpe, chat_format, decontamination, hard_negatives, licenses, merkle, ngram_join, packing, quality_model, quality_rules, sharding, sql, substring_dedup, toxicity
from citegrid.tables import table

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"), "doc_id", "text").drop("spans")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), "doc_id", "text").drop("text_hash")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), "doc_id", "text")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id", "text")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "labels"), "toxic")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.report(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "labels"), "quality")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.matches(docs, "doc_id", "text", bench, "item_id", "text")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(TOKENIZER))


def op9_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(TOKENIZER))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), "doc_id")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the conversation -1, whose texts look like its template."""
    said = F.lit(chat_format.CONTROL).alias("text")
    odd = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), said)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.report(turns.unionByName(odd), "conv_id", "turn", "role", "text")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_ngram_join": op2_ngram_join,
        "op3_quality_rules": op3_quality_rules,
        "op4_license_scans": op4_license_scans,
        "op5_toxicity": op5_toxicity,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_decontamination": op7_decontamination,
        "op8_bpe": op8_bpe,
        "op9_token_packing": op9_token_packing,
        "op10_sharding": op10_sharding,
        "op11_chat_format": op11_chat_format,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    """The other queries are tested against plain versions, round trips and held-out labels in tests/llm/."""
    return {
        "op1_substring_dedup": sql.SUBSTRING_DEDUP,
        "op2_ngram_join": sql.NGRAM_JOIN,
        "op3_quality_rules": sql.QUALITY_RULES,
        "op4_license_scans": sql.LICENSE_SCANS,
        "op7_decontamination": sql.DECONTAMINATION,
        "op11_chat_format": sql.CHAT_FORMAT,
        "op13_hard_negatives": sql.HARD_NEGATIVES,
    }
