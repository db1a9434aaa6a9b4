"""Guards of a type tree: whether a proposed edge would close a circle or make the tree too deep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Workspace, within


def _walk(edges: DataFrame, starts: DataFrame, from_: str, to: str, most: int, ws: Workspace, name: str) -> DataFrame:
    """``proposal, node, steps``: what is reached from the starts (proposal, node) in up to ``most`` steps, with the longest way; each round is written. A node can be met again on another way, but what is already on a circle ends with the rounds."""
    now = ws.save(starts.withColumn("steps", F.lit(0)), f"{name}-0")
    every = now
    along = edges.select(F.col(from_).alias("node"), F.col(to).alias("next")).where("node IS NOT NULL AND next IS NOT NULL").distinct()
    for k in range(1, most + 1):
        now = ws.save(now.join(along, "node").select("proposal", F.col("next").alias("node"), F.lit(k).alias("steps")).distinct(), f"{name}-{k}")
        if within(now, 0):
            break
        every = every.union(now)
    return every.groupBy("proposal", "node").agg(F.max("steps").alias("steps"))


def judge_edges(edges: DataFrame, proposals: DataFrame, most: int = 6) -> DataFrame:
    """``proposal, child, parent, cyclic, depth, accepted`` of proposed edges (proposal, child, parent) against (child, parent) edges.

    An edge closes a circle if the child is the parent or stands above it. Its depth is that of the longest chain through it, in edges; more than ``most`` is too deep (depths beyond that are told as ``most`` + 1). Chains are followed for ``most`` + 1 rounds at most: a longer way is refused for its depth anyway. Each proposal is judged by itself; null ends are refused.
    """
    ws = Workspace(edges.sparkSession, "hierarchy")
    asked = ws.save(proposals.select("proposal", "child", "parent"), "asked")
    up = _walk(edges, asked.where("parent IS NOT NULL").select("proposal", F.col("parent").alias("node")), "child", "parent", most + 1, ws, "up")
    down = _walk(edges, asked.where("child IS NOT NULL").select("proposal", F.col("child").alias("node")), "parent", "child", most + 1, ws, "down")
    above = up.groupBy("proposal").agg(F.max("steps").alias("above"))
    below = down.groupBy("proposal").agg(F.max("steps").alias("below"))
    circle = up.withColumnRenamed("node", "child").join(asked.select("proposal", "child"), ["proposal", "child"], "left_semi").select("proposal").distinct().withColumn("hit", F.lit(True))
    joined = asked.join(above, "proposal", "left").join(below, "proposal", "left").join(circle, "proposal", "left")
    depth = F.least(F.lit(most + 1), F.coalesce("above", F.lit(0)) + F.coalesce("below", F.lit(0)) + 1)
    cyclic = F.coalesce("hit", F.lit(False))
    fine = F.col("child").isNotNull() & F.col("parent").isNotNull() & ~cyclic & (depth <= most)
    return joined.select("proposal", "child", "parent", cyclic.alias("cyclic"), depth.cast("int").alias("depth"), fine.alias("accepted"))
