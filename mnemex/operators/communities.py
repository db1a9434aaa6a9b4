"""Communities by modularity: local moves and aggregated levels (Louvain), as joins.

Edges are kept in both directions. In a half round every second node (by a hash of node and round) looks at the communities of its neighbours and takes the one that gains most: weight towards it less what a random graph with these degrees
would have. It moves only where that gains over staying, ties go to the smaller community, and of two single nodes the one with the larger number moves. So nodes that would swap places don't both move, and results are the same however rows are dealt out.
A level ends when a round gains nothing; the best state counts. Then communities become nodes, their inner weight a loop, and the next level begins.

Every half round is two aggregates and joins on node or community, written to the shared folder; no task holds a community.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Workspace

DIGITS = 9  # of a gain


def turn(node: Column, round_: int) -> Column:
    """Whether a node may move in a half round: about half of all, others in the next one."""
    return F.pmod(F.xxhash64(node, F.lit(round_ // 2)) + round_, F.lit(2)) == 0


def modularity(both: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of labels (id, label) over edges in both directions (src, dst, weight)."""
    marked = both.join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst")
    sums = marked.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inner"), F.sum("weight").alias("all"))
    r = sums.agg(F.sum("inner").alias("i"), F.sum("all").alias("w"), F.sum(F.col("all") * F.col("all")).alias("s")).first()
    return (r.i / r.w - resolution * r.s / r.w**2) if r.w else 0.0


def _moved(both: DataFrame, degree: DataFrame, labels: DataFrame, total: float, round_: int, resolution: float) -> DataFrame:
    """Labels after a half round."""
    sized = degree.join(labels, "id").groupBy("label").agg(F.sum("degree").alias("weight"), F.count("*").alias("n"))
    towards = both.where("src <> dst").join(labels.toDF("dst", "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("near"))
    own = degree.join(labels, "id").select("id", "degree", F.col("label").alias("own")).where(turn(F.col("id"), round_))
    here = own.select("id", "degree", "own", F.col("own").alias("label")).join(towards, ["id", "label"], "left").withColumn("near", F.coalesce("near", F.lit(0.0)))
    there = own.join(towards, "id").where("label <> own").select("id", "degree", "own", "label", "near")
    seen = here.unionByName(there.select(*here.columns)).join(sized, "label").join(sized.select(F.col("label").alias("own"), F.col("n").alias("own_n")), "own")
    stays = F.col("label") == F.col("own")
    rest = F.col("weight") - F.when(stays, F.col("degree")).otherwise(0.0)
    score = F.round(F.col("near") - resolution * F.col("degree") * rest / total, DIGITS)
    swaps = (F.col("own_n") == 1) & (F.col("n") == 1) & (F.col("label") > F.col("own"))
    best = seen.where(stays | ~swaps).groupBy("id").agg(F.max(F.struct(score.alias("score"), stays.alias("stays"), (-F.col("label")).alias("minus"))).alias("b")).select("id", (-F.col("b.minus")).alias("new"))
    return labels.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"))


def louvain(edges: DataFrame, rounds: int = 10, levels: int = 10, least: float = 1e-6, resolution: float = 1.0) -> DataFrame:
    """``id, community`` for every node of an edge (src, dst, weight): the smallest node of its community. Weights of one pair in both directions and of repeated rows add up; those of 0 or less, null ends and loops don't count."""
    spark = edges.sparkSession
    ws = Workspace(spark, "communities")
    clean = edges.where("src <> dst AND weight > 0").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
    once = clean.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    both = ws.save(once.union(once.select("dst", "src", "weight")), "edges-0")
    names = ws.save(both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")), "names-0")
    total = both.agg(F.sum("weight")).first()[0]
    if not total:
        return names
    for level in range(levels):
        degree = ws.save(both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree")), f"degree-{level}")
        labels = ws.save(degree.select("id", F.col("id").alias("label")), f"labels-{level}-0")
        start = best_q = modularity(both, labels, resolution)
        best = labels
        for r in range(rounds):
            for half in (0, 1):
                labels = ws.save(_moved(both, degree, labels, total, 2 * r + half, resolution), f"labels-{level}-{2 * r + half + 1}")
            q = modularity(both, labels, resolution)
            if q <= best_q + least:
                break
            best, best_q = labels, q
        if best_q <= start + least:
            break
        least_of = best.groupBy("label").agg(F.min("id").alias("node"))  # named by their smallest node
        named = ws.save(best.join(least_of, "label").select("id", F.col("node").alias("label")), f"named-{level}")
        names = ws.save(names.join(named.toDF("community", "label"), "community").select("id", F.col("label").alias("community")), f"names-{level + 1}")
        marked = both.join(named.toDF("src", "a"), "src").join(named.toDF("dst", "b"), "dst")
        both = ws.save(marked.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")), f"edges-{level + 1}")
    return names
