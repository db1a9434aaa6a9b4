"""The operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, hard_negatives, language_model, periodic_runs, pii, quality, simhash, substring_dedup, token_counts, token_files, toxicity, url_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op1(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op2(_documents(spark, sf_dir).select("doc_id", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op3(_documents(spark, sf_dir).select("doc_id", "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op4(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op5(_documents(spark, sf_dir).select("doc_id", "text"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op6(_documents(spark, sf_dir).select("doc_id", "text"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op7(_documents(spark, sf_dir).select("doc_id", "text"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op8(_documents(spark, sf_dir).select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op9(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op10(_documents(spark, sf_dir).select("doc_id", "text", "source"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.op11(_documents(spark, sf_dir).select("doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.op12(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.op13(_documents(spark, sf_dir).select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_bpe": op2_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_pii": op5_pii,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_token_files": op7_token_files,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_language_model": op13_language_model,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": url_filter.ORACLE,
    "op10_quality_rules": quality.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
