"""Writes as plans: each gives the table that should replace the old one, or the rows to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Workspace


def upsert(current: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Incoming rows replace those with their key; of several incoming ones the last by ``order`` wins."""
    rest = [c for c in incoming.columns if c not in (key, *order)]
    newest = incoming.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in incoming.columns if c != key])
    kept = current.join(newest.select(key), key, "left_anti")
    return kept.unionByName(newest.select(*current.columns))


def insert_edges(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Edges to append: each (from, to, label) once, and only if it isn't there."""
    return incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")


def compare_and_set(current: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``updates`` has (key, expected, new); applied where the version is as expected, by force and without a bump where ``expected`` is null."""
    j = current.join(updates, key, "left")
    hit = F.col("new").isNotNull() & (F.col("expected").isNull() | (F.col("expected") == F.col("version")))
    out = j.withColumn(column, F.when(hit, F.col("new")).otherwise(F.col(column)))
    conflict = F.col("new").isNotNull() & ~hit
    return out.withColumn("conflict", F.coalesce(conflict, F.lit(False))).withColumn("version", F.col("version") + F.when(hit & F.col("expected").isNotNull(), 1).otherwise(0)).drop("expected", "new")


def archive(nodes: DataFrame, ids: DataFrame, key: str, archived: bool = True) -> DataFrame:
    marked = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return nodes.join(marked, key, "left").withColumn("archived", F.when(F.col("_hit"), F.lit(archived)).otherwise(F.col("archived"))).drop("_hit")


def delete(nodes: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return nodes.join(ids.select(key).distinct(), key, "left_anti")


def orphans(hyperedges: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return hyperedges.join(members.select(key), key, "left_anti")


def resolve_last_write(current: DataFrame, incoming: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """Per key the side with the later time, the incoming one on a tie."""
    i = incoming.select(key, *[F.col(c).alias(f"i_{c}") for c in [at, *columns]])
    wins = F.col(f"i_{at}").isNotNull() & (F.col(f"i_{at}") >= F.col(at))
    return current.join(i, key, "left").select(key, *[F.when(wins, F.col(f"i_{c}")).otherwise(F.col(c)).alias(c) for c in [at, *columns]], wins.alias("replaced"))


def merge_fields(current: dict[str, Column], incoming: dict[str, Column]) -> dict[str, Column]:
    """Field by field: the incoming value where there is one."""
    return {k: F.coalesce(incoming[k], v) if k in incoming else v for k, v in current.items()}


def next_of(ids: DataFrame, id_col: str) -> DataFrame:
    """Each id with the next larger one as ``by``: ranges are sorted apart, and only their first ids meet in one task."""
    parts = ids.select(id_col).distinct().repartitionByRange(id_col).withColumn("_part", F.spark_partition_id())
    inner = F.lead(id_col).over(W.partitionBy("_part").orderBy(id_col))
    own = Workspace(ids.sparkSession, "next").save(parts, "ids")
    first = own.groupBy("_part").agg(F.min(id_col).alias("_first"))  # one row a range
    following = first.select("_part", F.lead("_first").over(W.orderBy("_part")).alias("_next"))
    return own.withColumn("_inner", inner).join(following, "_part").select(id_col, F.coalesce("_inner", "_next").alias("by"))


def archive_with_lineage(nodes: DataFrame, replaced: DataFrame, id_col: str) -> DataFrame:
    """``kind, id, value``: each node with its flag (1: archived), and for each replaced node that is there an edge SUPERSEDES from ``by``, where known."""
    flagged = archive(nodes.select(id_col, "archived"), replaced.select(id_col), id_col)
    edges = replaced.join(nodes.select(id_col), id_col, "left_semi").where("by IS NOT NULL")
    return flagged.select(F.lit("node").alias("kind"), F.col(id_col).alias("id"), F.col("archived").cast("long").alias("value")).union(edges.select(F.lit("SUPERSEDES"), "by", id_col))


def upsert_vectors(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """``id, vector, state`` of (id, vector) after a batch: ``written`` or ``kept``. Null vectors of the batch write nothing; of several for one id the smallest counts."""
    new = batch.where("vector IS NOT NULL").groupBy("id").agg(F.min("vector").alias("_new"))
    both = stored.join(new, "id", "full")
    return both.select("id", F.coalesce("_new", "vector").alias("vector"), F.when(F.col("_new").isNotNull(), "written").otherwise("kept").alias("state"))
