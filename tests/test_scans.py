"""Ordered recurrences in two levels against plain loops, with one key that holds most rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mnemex.operators import governance as G
from mnemex.operators import ontology as O


def events(n, seed=1):
    r = random.Random(seed)
    return [(i, 1 if r.random() < 0.6 else r.randrange(2, 30), r.randrange(2000), r.random() < 0.3, r.gauss(0, 80)) for i in range(n)] + [(n, None, 1, True, 1.0)]


@pytest.mark.parametrize("parts", ["1", "7"])
def test_folds_of_hot_keys(spark, parts):
    rows = events(3000)
    df = spark.createDataFrame(rows, "id long, source long, at long, bad boolean, value double").repartition(5)
    trust, gate = {}, {}
    for i, s, at, bad, v in sorted(rows, key=lambda x: (x[2], x[0])):
        if s is None:
            continue
        t, n = trust.get(s, (1.0, 0))
        trust[s] = min(1.0, max(0.0, t + (-0.2 if bad else 0.05))), n + 1
        h, kept, n = gate.get(s, (0.0, 0, 0))
        h, n = 0.9 * h + 0.1 * math.tanh(v / 100), n + 1
        gate[s] = h, kept + (n <= 20 or 1 / (1 + math.exp(-(0.5 * h + 0.5 * v / 100))) > 0.5), n
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.source: (r.trust, r.writes) for r in G.trust_fold(df, "source", ["at", "id"], F.col("bad")).collect()}
        assert got == {s: (pytest.approx(t, abs=1e-6), n) for s, (t, n) in trust.items()}
        w = O.write_gate(df, "source", ["at", "id"], F.col("value") / 100, warmup=20)
        got = {r.source: tuple(r[1:]) for r in w.groupBy("source").agg(F.max_by("hidden", "place"), F.count_if("kept"), F.max("place")).collect()}
        assert got == {s: (pytest.approx(h, abs=1e-9), k, n) for s, (h, k, n) in gate.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert G.trust_fold(df.where("false"), "source", ["at", "id"], F.col("bad")).count() == 0
    assert O.write_gate(df.where("false"), "source", ["at", "id"], F.col("value")).count() == 0
