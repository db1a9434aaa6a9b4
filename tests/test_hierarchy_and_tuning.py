"""Guards of the type tree with planted circles; each rule of the tuning fold, revert and seeded tries."""

import random

import pytest
from pyspark.sql import functions as F

from mnemex.operators.hierarchy import judge_edges
from mnemex.operators.tuning import START, rounds, tune


def test_planted_circles_and_depths(spark):
    tree = [("b", "a"), ("c", "b"), ("d", "c"), ("e", "b"), ("x", "y"), ("y", "x"), (None, "a"), ("z", None)]  # x and y are a circle already
    asked = [(1, "a", "d"), (2, "a", "a"), (3, "e", "d"), (4, "new", "a"), (5, "a", "new"), (6, "x", "a"), (7, None, "a"), (8, "b", None), (9, "far", "d"), (10, "y", "y")]
    t = spark.createDataFrame(tree, "child string, parent string")
    got = {r.proposal: (r.cyclic, r.depth, r.accepted) for r in judge_edges(t, spark.createDataFrame(asked, "proposal int, child string, parent string"), 3).collect()}
    assert got == {
        1: (True, 4, False), 2: (True, 4, False), 3: (False, 4, False), 4: (False, 1, True), 5: (False, 4, False), 6: (False, 4, False), 7: (False, 1, False), 8: (False, 3, False), 9: (False, 4, False), 10: (True, 4, False),
    }
    assert judge_edges(t.where("false"), spark.createDataFrame(asked[3:4], "proposal int, child string, parent string")).first().accepted
    assert judge_edges(t, spark.createDataFrame([], "proposal int, child string, parent string")).count() == 0


def test_random_forests_against_a_plain_search(spark):
    r = random.Random(2)
    edges = [(i, r.randrange(i)) for i in range(1, 60) if r.random() < 0.8]
    asked = [(k, r.randrange(60), r.randrange(60)) for k in range(80)]
    above = dict(edges)

    def chain(x):
        out = [x]
        while out[-1] in above:
            out.append(above[out[-1]])
        return out

    height = {x: max([len(chain(y)) - 1 - (len(chain(x)) - 1) for y in range(60) if x in chain(y)]) for x in range(60)}
    want = {k: (c in chain(p), min(7, len(chain(p)) + height[c])) for k, c, p in asked}
    got = judge_edges(spark.createDataFrame(edges, "child long, parent long"), spark.createDataFrame(asked, "proposal long, child long, parent long"), 6).collect()
    assert {x.proposal: (x.cyclic, x.depth) for x in got} == want
    assert all(x.accepted == (not x.cyclic and x.depth <= 6) for x in got)


FINE = {"results": 5.0, "score": 0.5, "distinct": 3.0, "latency": 100.0, "degraded": False, "hits": 0.5, "hit_score": 0.0, "quality": 0.5}


def tuned(spark, days):
    rows = [(1, k, *{**FINE, **d}.values()) for k, d in enumerate(days)]
    df = spark.createDataFrame(rows, "key long, day int, results double, score double, distinct double, latency double, degraded boolean, hits double, hit_score double, quality double")
    return tune(rounds(df, "key", F.col("day"))).first()


@pytest.mark.parametrize(
    ("day", "change"),
    [
        ({"results": 1.0}, {"first": 6, "vector": 22, "keyword": 22}), ({"score": 0.1}, {"vector": 22}), ({"distinct": 1.0}, {"keyword": 22, "vector": 18}), ({"latency": 900.0}, {"vector": 18, "keyword": 18}),
        ({"latency": 900.0, "results": 1.0}, {"first": 6, "vector": 22, "keyword": 22}), ({"degraded": True}, {"first": 6}), ({"hits": 2.0, "hit_score": 0.5}, {"boost": 0.425}), ({"hits": 0.0}, {"boost": 0.375}), ({"hits": 2.0, "hit_score": 0.1}, {}), ({}, {}),
    ],
)
def test_each_rule(spark, day, change):
    got = tuned(spark, [day])
    assert {n: got[n] for n in START} == {**START, **change} and got.version == bool(change)


def test_revert_and_tries(spark):
    worse = tuned(spark, [{"score": 0.1}, *[{"quality": 0.1}] * 3])
    assert (worse.reverts, worse.vector, worse.version) == (1, 20, 1)
    patient = tuned(spark, [{"score": 0.1}, *[{"quality": 0.1}] * 2])
    assert (patient.reverts, patient.vector) == (0, 22)
    good = tuned(spark, [{"score": 0.1}, *[{"quality": 0.6}] * 3])
    assert (good.reverts, good.vector) == (0, 22)
    quiet = tuned(spark, [{}] * 6)
    moved = [n for n in ("w0", "w1", "w2") if quiet[n] != START[n]]
    assert quiet.version == 1 and len(moved) == 1 and abs(quiet[moved[0]] - START[moved[0]]) <= 0.1
    assert tuned(spark, [{}] * 6) == quiet and tuned(spark, [{}] * 5).version == 0
