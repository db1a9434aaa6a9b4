"""Parameters of retrieval that follow what snapshots of it say: a fold over rounds, one state a key.

A round is what all snapshots of a key and a stretch of time come to, one row by an aggregate. The fold takes a row a round (as many as there are stretches, however many snapshots), verifies the version in force, takes it back if it made things worse, and else lets six rules
propose the next; without a proposal for a while it tries one weight, by a draw that a hash of key and round makes, so it can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once

# What counts as few, low, uniform and slow, how a rule changes a size, and when a version is taken back.
FEW, LOW, UNIFORM, SLOW = 3, 0.3, 2, 500
DAMPING, LARGEST, BOOST = 0.5, 100, 0.55
FALL, SAMPLES, IDLE = 0.15, 3, 6
START = {"first": 5, "vector": 20, "keyword": 20, "boost": 0.4, "w0": 0.35, "w1": 0.4, "w2": 0.25}
SIZES = ["first", "vector", "keyword"]


def rounds(snapshots: DataFrame, key: str, stretch: Column) -> DataFrame:
    """``key, at`` and means of snapshots (results, score, distinct, latency, degraded, hits, hit_score, quality)."""
    return snapshots.groupBy(F.col(key).alias("key"), stretch.alias("at")).agg(
        F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("results", "score", "distinct", "latency", "hits", "hit_score", "quality")), F.max(F.col("degraded").cast("int")).alias("degraded"),
    )


def draw(key: Column, at: Column) -> Column:
    """A number from 0 to 1 (not included), the same for the same key and round."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), at.cast("string"))), 1, 8), 16, 10).cast("double") / 2**32


def _sized(now: Column, change: Column) -> Column:
    """A size after a relative change, rounded down; never under 1, and never pushed back by the upper bound."""
    return F.when(change != 0, F.least(F.greatest(F.lit(LARGEST), now + 1), F.greatest(F.lit(1), F.floor(now * (1 + change)).cast("int")))).otherwise(now)


def _step(s: Column, r: Column) -> Column:
    quality = F.when(s["samples"] == 0, r["quality"]).otherwise(0.7 * s["quality"] + 0.3 * r["quality"])
    seen = F.struct(quality.alias("quality"), (s["samples"] + 1).alias("samples"))

    def verified(v: Column) -> Column:
        worse = (s["version"] > s["kept"]) & (v["samples"] >= SAMPLES) & (s["before"]["quality"] > 0) & ((s["before"]["quality"] - v["quality"]) / s["before"]["quality"] > FALL)
        few, low, uniform, slow = r["results"] < FEW, r["score"] < LOW, r["distinct"] < UNIFORM, r["latency"] > SLOW
        part = lambda test, size: F.when(test, F.lit(size * DAMPING)).otherwise(0.0)
        vector = part(few, 0.25) + part(low, 0.25) - part(uniform & ~few, 0.125) - part(slow & ~few, 0.2)
        keyword = part(few, 0.25) + part(uniform, 0.25) - part(slow & ~few, 0.2)
        first = F.when(few | (r["degraded"] == 1), F.least(F.lit(LARGEST), s["first"] + 1)).otherwise(s["first"])
        boost = F.when((r["hits"] >= 1) & (r["hit_score"] >= LOW), F.least(F.lit(BOOST), F.round(s["boost"] + 0.05 * DAMPING, 4))).when(r["hits"] == 0, F.greatest(F.lit(0.0), F.round(s["boost"] - 0.05 * DAMPING, 4))).otherwise(s["boost"])
        said = F.struct(worse.alias("worse"), first.alias("first"), _sized(s["vector"], vector).alias("vector"), _sized(s["keyword"], keyword).alias("keyword"), boost.alias("boost"))

        def decided(p: Column) -> Column:
            changed = (p["first"] != s["first"]) | (p["vector"] != s["vector"]) | (p["keyword"] != s["keyword"]) | (p["boost"] != s["boost"])
            tries = ~changed & (s["idle"] + 1 >= IDLE)
            fresh = ~p["worse"] & (changed | tries)
            which, by = F.floor(r["draw"] * 3), F.round(r["draw"] * 3 - F.floor(r["draw"] * 3), 6) * 0.2 - 0.1
            weight = lambda i: F.when(tries & (which == i), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s[f"w{i}"] + by)), 4)).otherwise(s[f"w{i}"])
            take = lambda name, new: F.when(p["worse"], s["before"][name]).otherwise(new).alias(name)
            params = [take(n, p[n]) for n in (*SIZES, "boost")] + [take(f"w{i}", weight(i)) for i in range(3)]
            before = F.struct(*[F.when(fresh, s[n]).otherwise(s["before"][n]).alias(n) for n in START], F.when(fresh, v["quality"]).otherwise(s["before"]["quality"]).alias("quality"))
            return F.struct(
                *params, F.when(p["worse"], s["before"]["quality"]).otherwise(v["quality"]).alias("quality"), F.when(fresh, 0).otherwise(v["samples"]).alias("samples"), (s["version"] + F.when(fresh, 1).otherwise(0)).alias("version"),
                F.when(p["worse"], s["version"]).otherwise(s["kept"]).alias("kept"), (s["reverts"] + F.when(p["worse"], 1).otherwise(0)).alias("reverts"), F.when(fresh | p["worse"], 0).otherwise(s["idle"] + 1).alias("idle"), before.alias("before"),
            )

        return once(said, decided)

    return once(seen, verified)


def tune(rounds_: DataFrame) -> DataFrame:
    """``key``, the parameters in force after all rounds, ``version`` (how often they were changed), ``reverts`` and ``quality``."""
    params = [F.lit(v).alias(n) for n, v in START.items()]
    zero = F.struct(*params, F.lit(0.0).alias("quality"), F.lit(0).alias("samples"), F.lit(0).alias("version"), F.lit(0).alias("kept"), F.lit(0).alias("reverts"), F.lit(0).alias("idle"), F.struct(*params, F.lit(0.0).alias("quality")).alias("before"))
    fields = ["at", "results", "score", "distinct", "latency", "degraded", "hits", "hit_score", "quality"]
    row = F.struct(*fields, draw(F.col("key"), F.col("at")).alias("draw"))
    state = rounds_.groupBy("key").agg(F.aggregate(F.array_sort(F.collect_list(row)), zero, _step).alias("s"))
    return state.select("key", *(F.col(f"s.{n}").alias(n) for n in START), "s.version", "s.reverts", F.round("s.quality", 6).alias("quality"))
