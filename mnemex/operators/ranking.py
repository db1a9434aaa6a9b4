"""Ranked lists: dedup, fusion, caps, metrics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shared import Workspace, within


def top_k(df: DataFrame, keys: list[str], score: str, id_col: str, k: int) -> DataFrame:
    """The k best of each key with their rank; ties go to the smaller id."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), F.col(id_col))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dedup_best(df: DataFrame, keys: list[str | Column], score: Column, id_col: str) -> DataFrame:
    """The best row of each key, by one aggregate."""
    named = [(k if isinstance(k, Column) else F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
    best = df.select("*", *named).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.max(F.struct(score.alias("s"), (-F.col(id_col)).alias("n"), F.struct(*df.columns).alias("row"))).alias("b"))
    return best.select("b.row.*", F.col("b.s").alias("best_score"))


def fuse(channels: DataFrame, weights: dict[str, float], query_col: str = "query_id", id_col: str = "id") -> DataFrame:
    """Min-max scales each channel of each query (all equal: 1), weighs it, and sums per result.

    ``channels`` has (query, id, channel, score). The bounds come from an aggregate that joins back on the
    small (query, channel) key rather than a window over all candidates.
    """
    bounds = channels.groupBy(query_col, "channel").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = channels.join(bounds, [query_col, "channel"]).withColumn("s", F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    weight = F.coalesce(*[F.when(F.col("channel") == c, F.lit(w)) for c, w in weights.items()], F.lit(0.0))
    return scaled.groupBy(query_col, id_col).agg(F.sum(F.col("s") * weight).alias("score"), F.concat_ws("+", F.sort_array(F.collect_set("channel"))).alias("channels"))


def head_rerank(df: DataFrame, keys: list[str], head: int, new_score: Column, rank: str = "rank") -> DataFrame:
    """Reorders the first ``head`` rows of each list by ``new_score``; rows without one and the tail keep their slots."""
    inside = (F.col(rank) <= head) & new_score.isNotNull()
    slots = W.partitionBy(*keys, inside).orderBy(rank)
    best = W.partitionBy(*keys, inside).orderBy(F.desc(new_score), rank)
    marked = df.withColumn("_in", inside).withColumn("_slot", F.row_number().over(slots)).withColumn("_best", F.row_number().over(best))
    where = marked.where("_in").select(*keys, F.col("_slot").alias("_best"), F.col(rank).alias("_rank"))
    return marked.join(where, [*keys, "_best"], "left").withColumn(rank, F.when(F.col("_in"), F.col("_rank")).otherwise(F.col(rank))).drop("_in", "_slot", "_best", "_rank")


def cascade(df: DataFrame, query_col: str, tier: str) -> DataFrame:
    """Keeps, per query, the rows of the lowest tier that has any."""
    first = df.groupBy(query_col).agg(F.min(tier).alias("_first"))
    return df.join(first, query_col).where(F.col(tier) == F.col("_first")).drop("_first")


def fall_through(queries: DataFrame, levels: list[Callable[[DataFrame], DataFrame]], ws: Workspace) -> DataFrame:
    """``query_id, id, score, tier``: each level (queries to query_id, id, score) is asked only the queries that the levels before found nothing for; what it finds is written, so it is computed once."""
    found: list[DataFrame] = []
    rest = queries
    for tier, level in enumerate(levels, 1):
        found.append(ws.save(level(rest).select("query_id", "id", F.col("score").cast("double").alias("score"), F.lit(tier).alias("tier")), f"tier-{tier}"))
        rest = ws.save(rest.join(found[-1].select("query_id").distinct(), "query_id", "left_anti"), f"rest-{tier}")
        if within(rest, 0):
            break
    return reduce(DataFrame.union, found)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)
