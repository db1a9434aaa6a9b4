"""Version chains of entity properties, as-of reads, and decay."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = ["entity_id", "attr_name"]


def expire(versions: DataFrame) -> DataFrame:
    """Each version ends where the next of its chain begins; the order of arrival doesn't matter."""
    return versions.withColumn("expired_at", F.lead("valid_from").over(W.partitionBy(*KEY).orderBy("valid_from", "id")))


def version_chain(raw: DataFrame) -> DataFrame:
    """Drops repeats of the value before, then expires: one row per change of value."""
    order = W.partitionBy(*KEY).orderBy("valid_from", "id")
    changed = raw.withColumn("_old", F.lag("value").over(order)).where(F.col("_old").isNull() | (F.col("_old") != F.col("value"))).drop("_old")
    return expire(changed)


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    """The version of each chain that is valid at ``at``. One hash aggregate with map-side combine, no sort of chains."""
    alive = versions.where((F.col("valid_from") <= at) & (F.col("expired_at").isNull() | (F.col("expired_at") > at)))
    return alive.groupBy(*KEY).agg(F.max(F.struct("valid_from", "id", "value")).alias("v")).select(*KEY, "v.id", "v.value", "v.valid_from")


def latest(versions: DataFrame) -> DataFrame:
    """The newest unexpired version of each chain."""
    return versions.where(F.col("expired_at").isNull()).groupBy(*KEY).agg(F.max(F.struct("valid_from", "id", "value")).alias("v")).select(*KEY, "v.id", "v.value", "v.valid_from")


def keep_last(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in this order; Spark prunes before the shuffle."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def sliding_count(rows: DataFrame, keys: list[str], at: str, span: int, name: str, itself: bool = True) -> DataFrame:
    """``rows`` with how many of their keys lie in the ``span`` before them (both ends count; without ``itself`` nothing at the same moment does).

    ``at`` is a whole number, as microseconds. Each row stands in the stretch of its moment and, for others to count, in the next one; a window sorts
    one key's two stretches instead of all its history, so a key that holds much of the rows is spread over time."""
    own = F.floor(F.col(at) / (span + 1))
    both = rows.withColumn("_own", own).withColumn("_stretch", F.explode(F.array(own, own + 1)))
    w = W.partitionBy(*keys, "_stretch").orderBy(at).rangeBetween(-span, 0 if itself else -1)
    return both.withColumn(name, F.count(F.lit(1)).over(w)).where("_own = _stretch").drop("_own", "_stretch")


def running_number(rows: DataFrame, keys: list[str], at: str, tie: str, stretch: int, name: str) -> DataFrame:
    """``rows`` with their number, from 0 on, among those of their keys by (``at``, ``tie``).

    Numbers are counted within stretches of ``at`` (whole numbers) and raised by how many rows the stretches before hold, so no task sorts all rows of a key."""
    cut = rows.withColumn("_stretch", F.floor(F.col(at) / stretch))
    inner = cut.withColumn("_in", F.row_number().over(W.partitionBy(*keys, "_stretch").orderBy(at, tie)) - 1)
    held = cut.groupBy(*keys, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*keys, "_stretch", before.alias("_before"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_stretch"]]
    return inner.alias("a").join(held.alias("b"), reduce(and_, same), "left").select("a.*", (F.col("a._in") + F.col("b._before")).alias(name)).drop("_stretch", "_in")


def tau_window(importance: Column, core: Column, accesses: Column) -> Column:
    """Seconds after which tau falls to 1/e."""
    factor = (1 + importance * 0.5 * 2.0) * F.when(core, 2.0).otherwise(1.0) * F.when(accesses > 5, 1 + F.least(F.lit(1.0), accesses / 50)).otherwise(1.0)
    return F.least(F.lit(7200.0), F.greatest(F.lit(300.0), 1800.0 * factor))


def tau(tau0: Column, age_s: Column, window_s: Column) -> Column:
    return tau0 * F.exp(-age_s / window_s)


def phase_strength(tau_now: Column, age_s: Column, periods: list[float], alpha: float = 1.0) -> Column:
    """Decay mixed with the mean phase over several periods."""
    waves = sum((F.cos(2 * 3.141592653589793 * age_s / p) + 1) / 2 for p in periods) / len(periods)
    return alpha * tau_now + (1 - alpha) * waves


def is_decayed(tau_now: Column, importance: Column, degree: Column) -> Column:
    return (tau_now < 0.1) & ~((importance > 0.7) & (tau_now >= 0.05)) & ~(degree > 3)


def is_prunable(tau_now: Column, protected: Column, age_s: Column, degree: Column) -> Column:
    return (tau_now < 0.1) & ~(protected | (age_s < 7200) | (tau_now > 0.3) | (degree > 1))


def prune(nodes: DataFrame, prunable: Column, limit: float = 0.5) -> DataFrame:
    """Rows that stay. If more than ``limit`` of all would go, none does: the share is a scalar that the plan computes."""
    share = nodes.agg(F.avg(F.coalesce(prunable.cast("double"), F.lit(0.0)))).first()[0] or 0.0
    return nodes.where(~F.coalesce(prunable, F.lit(False))) if share <= limit else nodes
