"""Communities by modularity against a plain version with the same rules, and label propagation; pairs of similar strings against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from mnemex.operators import communities as C
from mnemex.operators.graph import knn_edges, label_propagation
from mnemex.operators.strings import edit_pairs


def turns(spark, nodes, rounds):
    df = spark.createDataFrame([(n,) for n in nodes], "id long").select("id", *[C.turn(F.col("id"), r).alias(f"r{r}") for r in range(rounds)])
    return {r.id: list(r)[1:] for r in df.collect()}


def modularity(w, label):
    total = sum(w.values())
    inner, every = {}, {}
    for (a, b), x in w.items():
        every[label[a]] = every.get(label[a], 0) + x
        if label[a] == label[b]:
            inner[label[a]] = inner.get(label[a], 0) + x
    return sum(inner.get(c, 0) / total - (x / total) ** 2 for c, x in every.items())


def plain(edges, turn, rounds=10, levels=10):
    w = {}
    for a, b, x in edges:
        if a != b and x > 0:
            for k in ((a, b), (b, a)):
                w[k] = w.get(k, 0) + x
    names = {a: a for a, _ in w}
    total = sum(w.values())
    for _ in range(levels):
        degree = {}
        for (a, _), x in w.items():
            degree[a] = degree.get(a, 0) + x
        label = {a: a for a in degree}
        start = top = modularity(w, label)
        best = label
        for r in range(2 * rounds):
            size, n = {}, {}
            for a, c in label.items():
                size[c], n[c] = size.get(c, 0) + degree[a], n.get(c, 0) + 1
            near = {a: {label[a]: 0.0} for a in label}
            for (a, b), x in w.items():
                if a != b:
                    near[a][label[b]] = near[a].get(label[b], 0) + x
            new = dict(label)
            for a, own in near.items():
                if turn[a][r]:
                    score = [(round(x - degree[a] * (size[c] - (degree[a] if c == label[a] else 0)) / total, C.DIGITS), c == label[a], -c) for c, x in own.items() if c == label[a] or not (n[label[a]] == 1 and n[c] == 1 and c > label[a])]
                    new[a] = -max(score)[2]
            label = new
            if r % 2:
                q = modularity(w, label)
                if q <= top + 1e-6:
                    break
                best, top = label, q
        if top <= start + 1e-6:
            break
        low = {}
        for a, c in best.items():
            low[c] = min(a, low.get(c, a))
        names = {a: low[best[c]] for a, c in names.items()}
        merged = {}
        for (a, b), x in w.items():
            k = low[best[a]], low[best[b]]
            merged[k] = merged.get(k, 0) + x
        w = merged
    return names


@pytest.mark.parametrize("seed", [1, 2])
def test_louvain_against_a_plain_version(spark, seed):
    r = random.Random(seed)
    edges = []
    for _ in range(400):
        a = r.randrange(90)
        edges.append((a, (a // 10) * 10 + r.randrange(10) if r.random() < 0.8 else r.randrange(90), r.choice((0.5, 1.0, 1.0, 2.0))))
    edges += [(500 + i, 500 + (i + 1) % 8, 1.0) for i in range(8)] + [(700, 701, 1.0), (1, 1, 9.0), (2, 3, 0.0), (2, 3, -4.0)]  # a ring, a pair, what doesn't count
    df = spark.createDataFrame([*edges, (None, 4, 1.0)], "src long, dst long, weight double").repartition(3)
    want = plain(edges, turns(spark, {a for e in edges for a in e[:2]}, 20))
    got = {x.id: x.community for x in C.louvain(df).collect()}
    assert got == want
    groups = {}
    for node, c in got.items():
        groups.setdefault(c, set()).add(node)
    assert all(c == min(g) for c, g in groups.items()) and got[700] == got[701] == 700
    w = {}
    for x, y, v in edges:
        if x != y and v > 0:
            for k in ((x, y), (y, x)):
                w[k] = w.get(k, 0) + v
    planted = {a: a // 10 if a < 90 else 50 + a // 100 for a in got}
    assert modularity(w, got) >= 0.95 * modularity(w, planted)


def test_modularity_beats_label_propagation(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    edges = knn_edges(e).cache()
    once = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    both = once.union(once.select("dst", "src", "weight"))
    ours = C.modularity(both, C.louvain(edges).toDF("id", "label"))
    theirs = C.modularity(both, label_propagation(edges))
    assert ours >= theirs and ours > 0.2


def test_empty_graphs(spark):
    none = spark.createDataFrame([(1, 1, 2.0)], "src long, dst long, weight double")
    assert C.louvain(none).count() == 0 and C.louvain(none.where("false")).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_edit_pairs_lose_none(spark, distance):
    r = random.Random(4)
    names = {"abcdefgh", "xbcdefgy", "", "a", "ab", "xy", "ü", "漢字"} | {"".join(r.choice("abcde") for _ in range(r.randint(0, 7))) for _ in range(150)}
    rows = list(enumerate(sorted(names)))
    got = {tuple(x) for x in edit_pairs(spark.createDataFrame(rows, "id long, name string"), distance).collect()}
    assert got == {(i, j, d) for i, a in rows for j, b in rows if i < j and (d := edit_distance(a, b)) <= distance}
