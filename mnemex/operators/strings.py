"""Similar strings without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Workspace


def deletions(text: Column, distance: int) -> Column:
    """Hashes of all strings that up to ``distance`` deletions leave of a text, itself included: two texts within that edit distance share one."""
    every = level = F.array(text)
    for _ in range(distance):
        level = F.array_distinct(F.flatten(F.transform(level, lambda t: F.transform(F.filter(F.sequence(F.lit(0), F.length(t)), lambda i: i > 0), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), t.substr(i + 1, F.length(t)))))))
        every = F.concat(every, level)
    return F.array_distinct(F.transform(every, lambda t: F.xxhash64(t)))


def edit_pairs(names: DataFrame, distance: int = 2) -> DataFrame:
    """``a, b, distance`` of all pairs of names (id, name) within an edit distance, a < b. Names are to be distinct and not null.

    Keys are hashes of what deletions leave, a quadratic number in the length of a name for two of them; ids meet by key, pairs are made distinct, and only then do the names join to be compared.
    """
    ws = Workspace(names.sparkSession, "edit-pairs")
    own = ws.save(names.select("id", "name"), "names")
    keys = ws.save(own.select("id", F.length("name").alias("n"), F.explode(deletions(F.col("name"), distance)).alias("key")), "keys")
    several = keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    met = keys.join(several, "key", "left_semi").select("id", "n", "key")
    pairs = met.toDF("a", "m", "key").join(met.toDF("b", "n", "key"), "key").where((F.col("a") < F.col("b")) & (F.abs(F.col("m") - F.col("n")) <= distance)).select("a", "b").distinct()
    pairs = ws.save(pairs, "pairs")
    both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    return both.select("a", "b", F.levenshtein("x", "y", distance).alias("distance")).where("distance >= 0")
