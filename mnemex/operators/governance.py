"""Write-time defence, trust, conflict resolution and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scans import clamped_sum

# How much a source type counts.
SOURCE_RANK = {"direct": 1.0, "tool": 0.7, "inferred": 0.5}


def source_rank(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in SOURCE_RANK.items()], F.lit(0.0))


def winner(new_type: Column, old_type: Column, new_trust: Column, old_trust: Column, old_tau: Column, protected: Column, track: Column) -> Column:
    """Whether the new fact replaces the old: never a protected one; a core fact only by a strictly better source; a better
    source wins, a worse one loses; among equals trust times tau decides if it differs by 0.05, else the newest."""
    new, old = source_rank(new_type), source_rank(old_type)
    gap = new_trust - old_trust * F.coalesce(old_tau, F.lit(1.0))
    return F.when(protected, False).when(track == "core", new > old).when(new > old, True).when(new < old, False).when(F.abs(gap) >= 0.05, gap > 0).otherwise(True)


def trust_fold(writes: DataFrame, source: str, order: list[str], blocked: Column) -> DataFrame:
    """Trust of each source after its writes in order: minus 0.2 for a blocked one, plus 1/20 for a good one, between 0 and 1."""
    out = clamped_sum(writes, source, order, F.when(blocked, -0.2).otherwise(0.05), 1.0, 0.0, 1.0)
    return out.select(source, F.round("value", 6).alias("trust"), F.col("n").alias("writes"))


def semantic_drift(rows: DataFrame, source: str, order: str, vector: str, least: float = 0.65) -> DataFrame:
    """Cosine of each vector with the mean of the ten before it from its source; drift below ``least`` from three on."""
    past = F.collect_list(vector).over(W.partitionBy(source).orderBy(order).rowsBetween(-10, -1))
    df = rows.withColumn("_past", past)
    zero = F.transform(F.col(vector), lambda x: F.lit(0.0))
    total = F.aggregate("_past", zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    df = df.withColumn("_sum", total)
    cos = dot(F.col("_sum"), F.col(vector)) / F.sqrt(dot(F.col("_sum"), F.col("_sum")) * dot(F.col(vector), F.col(vector)))
    n = F.size("_past")
    return df.withColumn("history", n).withColumn("similarity", F.when(n >= 3, F.round(cos, 6))).withColumn("drift", F.coalesce(F.col("similarity") < least, F.lit(False))).drop("_past", "_sum")


def verdict(spike: Column, drift: Column, crowded: Column, flood: Column, trust: Column, risk: Column) -> tuple[Column, Column]:
    """What the rules are meant to decide, and what remains if only distrust and critical content may block."""
    block = (trust < 0.3) | (risk == "critical")
    intended = F.when(block, "BLOCK").when(spike | drift | crowded | flood | (trust < 0.5) | (risk == "high"), "QUARANTINE").otherwise("ALLOW")
    return intended, F.when(block, "BLOCK").otherwise("ALLOW")


def audit_chain(blocks: DataFrame, operations: str, at: str) -> DataFrame:
    """``index, operations, at, previous, hash`` of blocks in the order of ``at``: each hash covers the one before. A chain is sequential; its blocks, one a run, are folded in one row."""
    listed = blocks.agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(operations).alias("operations")))).alias("b"))
    none = F.array().cast("array<struct<operations:string,at:string,previous:string,hash:string>>")

    def step(acc: Column, x: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", acc["last"], x["operations"], x["at"]), 256)
        return F.struct(digest.alias("last"), F.concat(acc["out"], F.array(F.struct(x["operations"].alias("operations"), x["at"].alias("at"), acc["last"].alias("previous"), digest.alias("hash")))).alias("out"))

    folded = F.aggregate("b", F.struct(F.lit("0" * 64).alias("last"), none.alias("out")), step)["out"]
    return listed.select(F.posexplode(folded).alias("index", "x")).select("index", "x.operations", "x.at", "x.previous", "x.hash")


def verify_chain(chain: DataFrame) -> DataFrame:
    """Per block: whether its hash is right and it names the hash before. Blocks are few (one a run), so one order is enough."""
    before = F.lag("hash", 1, "0" * 64).over(W.partitionBy("chain").orderBy("index"))
    right = F.sha2(F.concat_ws("|", "previous", "operations", "at"), 256)
    return chain.select("chain", "index", "hash", ((F.col("hash") == right) & (F.col("previous") == before)).alias("valid"))


def trigger(idle_for: Column, new: Column, conflicts: Column, since: Column, candidates: Column, idle: int, most_new: int, most_conflicts: int, soon: int, long: int, most_candidates: int) -> Column:
    """The rule that starts a consolidation, the first that holds; ``since`` is null before the first look."""
    return (
        F.when(since.isNotNull() & (since < soon), "too soon").when(idle_for > idle, "idle").when(new >= most_new, "accumulated").when(conflicts >= most_conflicts, "conflicts")
        .when(since.isNull() | (since >= long), "forced").when(candidates >= most_candidates, "candidates").otherwise("none")
    )


def check_versions(ops: DataFrame) -> DataFrame:
    """``txn, ops, conflicts, committed`` of operations (txn, node, checked, expected, version): a checked one that expects another version than the node has is a conflict; without an expectation it is none."""
    wrong = F.col("checked") & (F.col("expected") != F.col("version"))
    return ops.groupBy("txn").agg(F.count("*").alias("ops"), F.count_if(wrong).alias("conflicts")).withColumn("committed", F.col("conflicts") == 0)
