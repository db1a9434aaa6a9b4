"""The driver's tables read as agent-memory tables, and the same as SQL for the oracle.

An episode is a document; what documents don't have (times, tau, flags) is derived from the
id by plain arithmetic, so both engines see equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPISODES_SQL = """(SELECT doc_id AS id, text AS content, source, lang AS namespace,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at, ((doc_id * 37) % 100)::DOUBLE / 100 AS tau_initial,
  CASE WHEN doc_id % 5 = 0 THEN 'core' ELSE 'active' END AS fact_track,
  CASE doc_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'tool' ELSE 'inferred' END AS source_type,
  doc_id % 7 = 0 AS archived, doc_id % 11 = 0 AS quarantine, doc_id % 13 = 0 AS protected,
  (doc_id % 3 + 1)::INT AS version FROM documents)"""

VERSIONS_SQL = """(SELECT event_id AS id, user_id AS entity_id, event_type AS attr_name, (value * 100)::BIGINT AS value, ts AS valid_from,
  lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS expired_at FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), F.col("text").alias("content"), "source", F.col("lang").alias("namespace"),
        F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("created_at"), ((i * 37) % 100 / 100).alias("tau_initial"),
        F.when(i % 5 == 0, "core").otherwise("active").alias("fact_track"),
        F.when(i % 3 == 0, "direct").when(i % 3 == 1, "tool").otherwise("inferred").alias("source_type"),
        (i % 7 == 0).alias("archived"), (i % 11 == 0).alias("quarantine"), (i % 13 == 0).alias("protected"), (i % 3 + 1).cast("int").alias("version"),
    )


def property_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.temporal import expire

    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("attr_name"),
        F.round(F.col("value") * 100).cast("long").alias("value"), F.col("ts").cast("timestamp").alias("valid_from"),
    )
    return expire(raw)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperedge membership: orders hold parts."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hyperedge_id"), F.col("l_partkey").alias("episode_id")).distinct()


MEMBERS_SQL = "(SELECT DISTINCT l_orderkey AS hyperedge_id, l_partkey AS episode_id FROM lineitem)"
