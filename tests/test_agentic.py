"""Rounds of retrieval against a plain loop; anchors of all three kinds."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemex.functions import text as X
from mnemex.operators.agentic import agentic, anchors

def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def test_anchors_of_three_kinds(spark):
    rows = [
        (1, 1, "The revenue of Nova Labs rose. nova labs has many users"), (1, 2, "Acme and NOVA LABS met yesterday; Price and Revenue"), (1, 3, "in 1999 Zeta met Acme"),
        (2, 1, "the the and of"), (3, 1, "Berlin in 2003"), (4, 2, "3 days ago Rome fell"), (4, 1, "Rome is old"),
    ]
    got = {r.query_id: r for r in anchors(spark.createDataFrame(rows, "query_id long, rank int, content string").repartition(4), now()).collect()}
    assert list(got[1].entities) == ["Nova Labs", "revenue", "rose", "nova", "labs"]
    assert sorted(got[1].attributes) == ["price", "revenue", "users"] and got[1].time == "time:yesterday"
    assert list(got[2].anchors) == [] and got[2].time is None
    assert got[3].time == "time:1072915199" and list(got[3].entities) == ["Berlin"]
    assert got[4].time == "time:3_day_ago" and list(got[4].entities)[0] == "Rome"
    assert list(got[1].anchors)[:5] == list(got[1].entities) and sorted(list(got[1].anchors)[5:]) == ["price", "time:yesterday", "users"]


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau ypsilon".split()


def retrieve_plain(asked, docs, flat, k=4):
    out = []
    for q, text in asked:
        want = set(text.lower().split())
        score = sorted(((len(want & set(t.lower().split())) ** (not flat) + 0.001 * (i % 7), -i) for i, t in docs if want & set(t.lower().split())), reverse=True)
        out += [(q, -i, round(s, 6)) for s, i in score[:k]]
    return out


def retrieve(docs, flat, k=4):
    held = docs.select("id", F.explode(F.array_distinct(F.split(F.lower("content"), " "))).alias("w"))

    def run(asked):
        q = asked.select("query_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
        s = q.join(held, "w").groupBy("query_id", "id").agg(F.count("*").alias("n")).withColumn("score", F.round((F.lit(1) if flat else F.col("n")) + 0.001 * (F.col("id") % 7), 6)).drop("n")
        return s.withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("k") <= k).drop("k")

    return run


def entities(text, most=5):
    import re

    found = re.findall(rf"\b({X.NAME})\b", text) + re.findall(r"\b([a-z]{2,})\b", text)
    out = []
    for x in found:
        if x.lower() not in X.QUERY_STOP + X.TIME_STOP and x.lower() not in [y.lower() for y in out]:
            out.append(x)
    return out[:most]


def plain(queries, docs, flat, steps=3, top=12, least_new=3):
    content, results = dict(docs), []
    for q, text in queries:
        mine, seen = {}, set()
        for step in range(1, steps + 1):
            for _, i, s in retrieve_plain([(q, text)], docs, flat):
                mine.setdefault(i, (s, step))
            if step == steps:
                break
            head = sorted(mine.items(), key=lambda x: (-x[1][0], x[0]))[:top]
            if not head:
                break
            hi, lo = head[0][1][0], head[-1][1][0]
            if hi > 0 and (hi - lo) / hi >= 0.25 and len(head) >= 3:
                break
            names = []
            for i, _ in head:
                names += [x for x in entities(content[i]) if x.lower() not in [y.lower() for y in names]]
            names = names[:5]
            if len({x.lower() for x in names} - seen) < least_new:
                break
            seen |= {x.lower() for x in names}
            text = " ".join(names)
        results += [(q, i, s, step) for i, (s, step) in mine.items()]
    return sorted(results)


def test_rounds_against_a_plain_loop(spark):
    r = random.Random(8)
    docs = [(i, " ".join(r.choice(WORDS).capitalize() if r.random() < 0.2 else r.choice(WORDS) for _ in range(r.randint(1, 9)))) for i in range(80)]
    queries = [(q, " ".join(r.choice(WORDS) for _ in range(r.randint(1, 3)))) for q in range(25)] + [(99, "nothing here")]
    d = spark.createDataFrame(docs, "id long, content string")
    seen = set()
    for least_new, flat in ((3, False), (1, True)):
        got = agentic(spark.createDataFrame(queries, "query_id long, text string"), retrieve(d, flat), d, now(), least_new=least_new)
        want = plain(queries, docs, flat, least_new=least_new)
        assert sorted(map(tuple, got.select("query_id", "id", F.round("score", 6), "step").collect())) == want
        seen |= {x[3] for x in want}
    assert seen == {1, 2, 3}
    none = agentic(spark.createDataFrame(queries[-1:], "query_id long, text string"), retrieve(d, False), d, now())
    assert none.count() == 0
