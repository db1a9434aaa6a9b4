"""Retrieval over all documents: against brute force."""

import math
import random
import re
from collections import Counter

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
DOCS = [
    (1, "red apples and green pears"), (2, "Green pears only"), (3, "the dog runs over red hills"), (7, "pears, pears and more pears"), (10, "nothing of it here"), (11, "hills and dogs"),
    (13, "red red red apples"), (20, "a dog"), (21, "apples"), (29, "over the hills and far away"),
]
ITEMS = [(1, "red apples"), (2, "a dog on the hills"), (3, "green pears"), (4, "unheard"), (6, "far hills")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return home


def words(text):
    return [w for w in re.split("[^a-z0-9à-ÿ]+", text.lower()) if len(w) > 1]


def grams(text):
    return [p[i : i + k] for t in text.lower().split() for p in [f" {t} "] for k in (2, 3, 4) for i in range(len(p) - k + 1)]


def idfs(counts):
    df = Counter(t for c in counts.values() for t in c)
    return {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}


def best(scores, k):
    return sorted(((i, s) for i, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))[:k]


def ranked():
    """All BM25 scores of all questions, over all documents."""
    tf = {i: Counter(words(t)) for i, t in DOCS}
    idf, mean = idfs(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    for q, text in ITEMS:
        scores = {i: round(sum(idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in set(words(text)) if t in c), 6) for i, c in tf.items()}
        yield q, text, best(scores, 10)


def test_bm25_ranks_every_document(spark, folder):
    wanted = [(q, i, pytest.approx(s, abs=2e-6)) for q, _, found in ranked() for i, s in found]
    got = QUERIES["v8_bm25_topk"](spark, folder).collect()
    assert sorted((r.query_id, r.id, r.score) for r in got) == sorted(wanted, key=lambda x: x[:2])


def test_community_relevance_is_that_among_the_candidates(spark, folder):
    summaries = {}
    for i, t in sorted(DOCS):
        summaries.setdefault(i // 20, []).append(t[:100])
    wanted, expanded = [], []
    for q, text, found in ranked():
        own = {c: Counter(grams(" ".join(summaries[c][:5]))) for c in {i // 20 for i, _ in found[:5]}}
        idf = idfs(own) if own else {}
        weights = {}
        for c, tf in own.items():
            raw = {t: n * idf[t] for t, n in tf.items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            weights[c] = {t: x / norm for t, x in raw.items()}
        mean = sum(sum(w.values()) for w in weights.values()) / len(weights) if weights else 1
        for c, w in weights.items():
            score = sum(idf[t] * w[t] * 2.5 / (w[t] + 1.5 * (0.25 + 0.75 * sum(w.values()) / mean)) for t in set(grams(text)) if t in w)
            if score:
                relevance = score / (1 + score)
                wanted.append((q, c, pytest.approx(relevance, abs=2e-6)))
                if relevance >= 0.5:
                    members = [i for i, _ in sorted(DOCS) if i // 20 == c][:10]
                    expanded += [(q, i, pytest.approx(relevance * found[:5][-1][1] * 0.6, abs=1e-5)) for i in members if i not in dict(found)]
    got = QUERIES["v16_community_relevance"](spark, folder).collect()
    assert sorted((r.query_id, r.community, r.relevance) for r in got) == sorted(wanted, key=lambda x: x[:2])
    more = QUERIES["v15_community_expansion"](spark, folder).collect()
    assert expanded and sorted((r.query_id, r.id, r.score) for r in more) == sorted(expanded, key=lambda x: x[:2])


def test_tfidf_cosine_searches_every_document(spark, folder):
    tf = {i: Counter(grams(t)) for i, t in DOCS}
    idf = idfs(tf)
    weigh = lambda c: {t: n * idf[t] for t, n in c.items() if t in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    wanted = []
    for q, text in ITEMS:
        a = weigh(Counter(grams(text)))
        scores = {i: round(sum(x * b.get(t, 0) for t, x in a.items()) / (norm(a) * norm(b)), 6) for i, b in ((i, weigh(c)) for i, c in tf.items())}
        wanted += [(q, i, pytest.approx(s, abs=2e-6)) for i, s in best(scores, 20)]
    got = QUERIES["v10_tfidf_cosine"](spark, folder).collect()
    assert sorted((r.query_id, r.id, r.score) for r in got) == sorted(wanted, key=lambda x: x[:2])


def test_tfidf_over_a_large_vocabulary_and_many_blocks(spark):
    """The size switch and blocks of queries change nothing."""
    from mnemex.operators.tfidf import tfidf_cosine

    docs = spark.createDataFrame([*DOCS, (None, "no id"), (10_000, None), (10_001, " ")], "id long, text string")
    asked = spark.createDataFrame([*ITEMS, (900, None), (901, "漢字 ÄÖ"), (None, "x y")], "query_id long, text string")
    want = sorted(map(tuple, tfidf_cosine(asked, docs).collect()))
    assert want
    for options in ({"block": 1}, {"largest": 3}):
        got = sorted(map(tuple, tfidf_cosine(asked.where("query_id IS NOT NULL"), docs.where("id IS NOT NULL"), **options).collect()))
        assert [(x[0], x[1], x[3]) for x in got] == [(x[0], x[1], x[3]) for x in want]
        assert [x[2] for x in got] == [pytest.approx(x[2], abs=2e-6) for x in want]
    assert tfidf_cosine(asked, docs.where("false")).count() == 0


def test_text_fallback_copies_no_text(spark):
    """Phrases of any length and kind against a plain search, in one block and in many; before, a text was copied for each of the queries' words in it."""
    from mnemex.operators.retrieval import text_fallback

    texts = ["The old man and THE sea", "the old man", "Ärger über İstanbul", "x", "", "aaaaaaaaaaaaaaaaaaaa", "漢字 and 🎈 signs", "the sea", None, "THE OLD MAN AND THE SEA, again", "and" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    phrases = ["the old man", "The Sea", "x", "", "aaaaaaaa", "aaaaaaa", "字 and 🎈", "and the sea, AGAIN", "none of these", None, "the sea", "ÄRGER", "andandandandandandandandandandandandan", " "]
    asked = spark.createDataFrame([*enumerate(phrases), (None, "x")], "query_id long, phrase string")
    low = lambda t: t.lower() if t is not None else None
    wanted = sorted((str(q), i, 0.5) for q, p in [*enumerate(phrases), (None, "x")] for i, t in enumerate(texts) if p is not None and t is not None and low(p) in low(t))
    for block in (50, 3):
        found = text_fallback(asked, docs, block)
        assert sorted((str(r.query_id), r.id, r.score) for r in found.collect()) == wanted
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert text_fallback(asked.where("false"), docs).count() == 0


def test_gram_bm25_meets_different_texts(spark, monkeypatch):
    """Equal names are scored once, with the figures and ties of a search over all rows; before, each query met each row."""
    from mnemex.operators import ranking as R
    from mnemex.operators import retrieval as X

    names = ["old ring", "new ring", "ring", None, "", "blue anvil", "old anvil ring", "ring old"]
    docs = spark.createDataFrame([(i, names[i * 7 % len(names)]) for i in range(160)], "id long, text string")
    asked = docs.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    plain = X.gram_bm25(asked.selectExpr("*", "0 AS corpus"), docs.selectExpr("*", "0 AS corpus"), "corpus")
    wanted = {(r.query_id, r.id, r["rank"]): r.score for r in R.top_k(plain.selectExpr("query_id", "id", "round(score, 4) AS score"), ["query_id"], "score", "id", 30).collect()}
    met = []
    scored = X.gram_bm25
    monkeypatch.setattr(X, "gram_bm25", lambda *a: met.append(scored(*a)) or met[-1])
    got = {(r.query_id, r.id, r["rank"]): r.score for r in X.gram_bm25_best(asked, docs, 30).collect()}
    assert got == pytest.approx(wanted, abs=1e-4) and wanted
    assert met[0].count() <= len(names) ** 2 < plain.count()


def test_tfidf_makes_the_grams_of_a_text_once_for_many_queries(spark, monkeypatch):
    """Before, there was a pass over all documents for each 500 queries."""
    from mnemex.operators import tfidf

    passes, begin = [], tfidf.Asked.__init__
    monkeypatch.setattr(tfidf.Asked, "__init__", lambda self, lines: passes.append(len(lines)) or begin(self, lines))
    docs = spark.createDataFrame(DOCS, "id long, text string")
    many = [(k, DOCS[k % len(DOCS)][1]) for k in range(1200)]
    got = tfidf.tfidf_cosine(spark.createDataFrame(many, "query_id long, text string"), docs, k=3).collect()
    assert len(passes) == 1
    first = {(r.query_id, r.rank): (r.id, r.score) for r in got}
    assert first and all(first[q, n] == first[q % len(DOCS), n] for q, n in first)


def test_tfidf_lets_only_the_best_of_a_task_leave(spark, monkeypatch):
    """Rough products drop what can't count and change nothing, whatever the split between common and other grams; before, each batch of a task let the best of each query leave, however low."""
    from mnemex.operators import tfidf

    r = random.Random(4)
    texts = ["".join(r.choice("abcdef  ") for _ in range(r.choice((12, 60, 300)))) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (400, texts[0]), (401, "ÿÿÿ")], "id long, text string").coalesce(1)
    asked = {q: texts[q * 7][:30] for q in range(40)} | {40: texts[0][:30].upper(), 41: "漢字", 42: "ÿÿÿ"}
    tf = {i: Counter(grams(t)) for i, t in [*enumerate(texts), (400, texts[0]), (401, "ÿÿÿ")]}
    idf = idfs(tf)
    unit = lambda c: (lambda v: {t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()})({t: n * idf[t] for t, n in c.items() if t in idf})
    held, wanted = {i: unit(c) for i, c in tf.items()}, {}
    for q, text in asked.items():
        own = unit(Counter(grams(text)))
        scores = {i: round(sum(x * d.get(t, 0) for t, x in own.items()), 6) for i, d in held.items()}
        wanted |= {(q, i): s for i, s in best(scores, 5) if s >= 0.3}
    left, top_k = [], tfidf.top_k
    monkeypatch.setattr(tfidf, "top_k", lambda df, *a: left.append(df.count()) or top_k(df, *a))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        for common, step in ((8, 50), (1024, 1_000_000)):
            monkeypatch.setattr(tfidf, "COMMON", common)
            monkeypatch.setattr(tfidf, "STEP", step)
            got = tfidf.tfidf_cosine(spark.createDataFrame(list(asked.items()), "query_id long, text string"), docs, k=5, least=0.3).collect()
            assert {(x.query_id, x.id): x.score for x in got} == pytest.approx(wanted, abs=2e-6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert wanted and max(left) <= 5 * len(asked)
