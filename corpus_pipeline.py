"""Toxicity, near-duplicates, benchmark passages, personal data and tokens, in this order.

Each stage gets the documents its predecessor kept and calls one operator; ``run`` writes
each result as Parquet to the shared folder and reads it again, so a lost executor never
costs more than the stage it was in.

All stages but the last return the columns of their input, whatever else they are called. Null and empty texts are no reason to drop a document: they score 0, have no passage and no
personal data, and are encoded as no ids. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemex.llm import bpe, decontaminate, pii, simhash, toxicity
from mnemex.shared import Workspace


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go. Equal rows go or stay together; without labels of both kinds all stay; null ids are judged like others."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, Jaccard 0.8) stays: that with the smallest id. Repeated rows of one id and text become one; null texts are one group, with those that have no word; rows without an id stay."""
    return simhash.near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, with all their copies; an empty benchmark removes none."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text and stays where the text is null. No row goes."""
    return pii.redact_pii(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with digests of ids and decoded text, by doc_id; ``lang``, ``source`` and ``n_chars`` are not kept. One row for each row, repeated ones too."""
    return bpe.encode_documents(docs, cache=150_000, pieces=75_000)  # worker processes hold other stages' tables too


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

# No stage but the filter by benchmark could be put into SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
