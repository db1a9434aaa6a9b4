"""Connected components by alternating large-star and small-star rounds.

Each round replaces the edge set by one that connects the same nodes with fewer
hops, until every node points straight at the smallest node of its component.
Rounds needed grow with the logarithm of the component diameter. Every half round is
written to the shared folder: lineage stays short, a lost executor costs one
round, and both join inputs are plain exchanges that AQE may split when a hub is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import Workspace


def _star(edges: DataFrame, ws: Workspace, table: str, large: bool) -> DataFrame:
    """``edges`` has u > v. Large star looks at both directions, small star at u's smaller neighbours."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    low = ws.save(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{table}-min")
    joined = near.join(low, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return ws.save(out.where(F.col("u") != F.col("v")).distinct(), table)


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node that some edge between two different nodes names.

    ``component`` is the smallest node reachable. Null ends, loops, repeated and
    two-way edges are allowed and add nothing; no edges give an empty table.
    """
    spark: SparkSession = edges.sparkSession
    ws = Workspace(spark, "components")
    x, y = F.col(a), F.col(b)
    clean = edges.where(x.isNotNull() & y.isNotNull() & (x != y))
    now = ws.save(clean.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "start")

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    for k in range(max_rounds if before[0] else 0):
        now = _star(_star(now, ws, f"large-{k}", True), ws, f"small-{k}", False)
        ws.drop(f"large-{k}"), ws.drop(f"large-{k}-min"), ws.drop(f"small-{k}-min")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
