"""Ranked retrieval: channels, fusion, expansion, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking as R
from ..operators import retrieval as X
from ..operators.agentic import agentic, anchors, sufficient
from ..operators.temporal import as_of, keep_last
from ..operators.tfidf import tfidf_cosine
from ..operators.vectors import nearest
from ..shared import Workspace, within
from ..sources.tables import EPISODES_SQL, VERSIONS_SQL, episodes, members, property_versions, table
from .catalog import query
from .enrichment import contracted_sql
from .relational import COMEMBERS_SQL, co_members

TEN = "WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10"
WEIGHTS = {"vector": 0.35, "bm25": 0.40, "entity": 0.25}


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), rows


WORDS_SQL = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-ÿ]+'), lambda x: length(x) > 1)"
QUESTIONS_SQL = "SELECT item_id AS query_id, text FROM benchmark"


def bm25_sql(asked: str = QUESTIONS_SQL) -> str:
    """The common tables of BM25; ``r`` has query_id, id and score of all hits."""
    return f"""WITH d AS (SELECT doc_id AS id, {WORDS_SQL} AS w FROM documents), s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
p AS (SELECT id, term, n AS length, count(*) AS tf FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT query_id, unnest({WORDS_SQL}) AS term FROM ({asked})), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
r AS (SELECT query_id, id, round(sum((ln((1 + docs) / (1 + df)) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6)::DOUBLE AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL)"""


BM25_SQL = bm25_sql()


@query(f"{BM25_SQL} SELECT query_id, id, score FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10")
def v8_bm25_topk(spark, sf_dir):
    return X.bm25(questions(spark, sf_dir), documents(spark, sf_dir)).select("query_id", "id", "score")


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents) GROUP BY term")
def v7_term_totals(spark, sf_dir):
    """Index statistics: documents that hold a term, and how often it stands."""
    p = X.postings(documents(spark, sf_dir), X.words(F.col("text")))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


GRAMS_SQL = "flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> ''), lambda t: flatten(list_transform([2, 3, 4], lambda k: list_transform(range(1, length(t) + 4 - k), lambda i: substr(' ' || t || ' ', i, k))))))"


def gram_bm25_sql(asked: str, held: str) -> str:
    """Common tables of BM25 over character grams; ``asked`` has query_id, corpus, text, ``held`` has corpus, id, text; ``g`` has the scores."""
    return f"""h AS ({held}), t AS (SELECT corpus, id, term, count(*) AS tf FROM (SELECT corpus, id, unnest({GRAMS_SQL}) AS term FROM h) GROUP BY ALL), n AS (SELECT corpus, count(*) AS n FROM h GROUP BY 1),
i AS (SELECT corpus, term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM t JOIN n USING (corpus) GROUP BY ALL), w AS (SELECT t.*, idf, tf * idf AS w FROM t JOIN i USING (corpus, term)),
l AS (SELECT corpus, id, sqrt(sum(w * w)) AS norm, sum(w) / sqrt(sum(w * w)) AS length FROM w GROUP BY ALL), m AS (SELECT corpus, avg(coalesce(length, 0)) AS mean FROM h LEFT JOIN l USING (corpus, id) GROUP BY 1),
g AS (SELECT query_id, corpus, id, sum(idf * (w / norm) * 2.5 / (w / norm + 1.5 * (0.25 + 0.75 * length / mean))) AS score
  FROM (SELECT DISTINCT query_id, corpus, unnest({GRAMS_SQL}) AS term FROM ({asked})) JOIN w USING (corpus, term) JOIN l USING (corpus, id) JOIN m USING (corpus) GROUP BY ALL)"""


@query(f"""WITH {gram_bm25_sql("SELECT p_partkey AS query_id, 0 AS corpus, p_name AS text FROM part WHERE p_partkey % 100 = 0", "SELECT 0 AS corpus, p_partkey AS id, p_name AS text FROM part")}
SELECT query_id, id, round(score, 4)::DOUBLE AS score FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, id) <= 10""")
def v8_gram_bm25(spark, sf_dir):
    """BM25 as the index builds it: grams within words, TF-IDF weights of unit length for counts; names of parts against each other."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return X.gram_bm25_best(p.where("id % 100 = 0").withColumnRenamed("id", "query_id"), p).select("query_id", "id", "score")


NAMES_SQL = "list_distinct(regexp_extract_all(text, '([A-Z][a-z]+(?:\\s[A-Z][a-z]+)*)', 1))"
ENTITY_SQL = f"""(SELECT query_id, id, score FROM (SELECT q.query_id, d.id, round(max(least(1.0, 0.3 + 0.7 * length(d.name) / n)), 6)::DOUBLE AS score
FROM (SELECT item_id AS query_id, unnest({NAMES_SQL}) AS name FROM benchmark) q JOIN (SELECT doc_id AS id, length(text) AS n, unnest({NAMES_SQL}) AS name FROM documents) d ON q.name = d.name AND length(q.name) > 3 GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)"""


@query(f"SELECT * FROM {ENTITY_SQL}")
def v9_entity_channel(spark, sf_dir):
    return X.entity_channel(questions(spark, sf_dir), documents(spark, sf_dir)).select("query_id", "id", "score")


COS_SQL = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
FUSED_SQL = f"""{BM25_SQL}, v AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({COS_SQL}, 6)::DOUBLE AS score FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
c AS (SELECT query_id, id, 'bm25' AS channel, score FROM (SELECT * FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10) UNION ALL SELECT query_id, id, 'entity', score FROM {ENTITY_SQL}
  UNION ALL SELECT query_id, id, 'vector', score FROM (SELECT * FROM v WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)),
n AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM c WINDOW w AS (PARTITION BY query_id, channel)),
u AS (SELECT query_id, id, sum((CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END) * CASE channel WHEN 'bm25' THEN 0.40 WHEN 'entity' THEN 0.25 ELSE 0.35 END) AS score, string_agg(DISTINCT channel, '+' ORDER BY channel) AS channels FROM n GROUP BY ALL)"""


def _channels(spark, sf_dir):
    """Ten best of each channel. The vector of a question is the stored one of its id: encoders are plug-ins. Written once, since fusion reads them twice."""
    q, d = questions(spark, sf_dir), documents(spark, sf_dir)
    rows = vectors(spark, sf_dir)[1]
    asked = rows.withColumnRenamed("id", "query_id").join(q.select("query_id"), "query_id", "left_semi")
    parts = {"bm25": X.bm25(q, d), "entity": X.entity_channel(q, d), "vector": nearest(asked, rows).where("score > 0")}
    every = reduce(DataFrame.union, [x.select("query_id", "id", F.lit(name).alias("channel"), "score") for name, x in parts.items()])
    return Workspace(spark, "channels").save(every, "channels")


@query(f"{FUSED_SQL} SELECT query_id, id, round(score, 4)::DOUBLE AS score, channels FROM u")
def a21_score_fusion(spark, sf_dir):
    return R.fuse(_channels(spark, sf_dir), WEIGHTS).select("query_id", "id", F.round("score", 4).alias("score"), "channels")


@query(f"""{FUSED_SQL}, t AS (SELECT u.*, round(score * (1 + 1 / (1 + exp(-e.tau_initial / 60))), 4)::DOUBLE AS s, left(content, 100) AS prefix FROM u JOIN {EPISODES_SQL} e USING (id) WHERE NOT archived),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id, prefix ORDER BY s DESC, id) = 1)
SELECT query_id, id, least(1.0, s)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INT AS rank FROM b QUALIFY rank <= 10""")
def v13_fused_retrieval(spark, sf_dir):
    """BM25, entities and vectors, fused, boosted by tau, archived ones dropped, copies by prefix dropped, ten best by the unclamped score."""
    fused = R.fuse(_channels(spark, sf_dir), WEIGHTS)
    e = episodes(spark, sf_dir).select("id", F.substring("content", 1, 100).alias("prefix"), "tau_initial", "archived").where("NOT archived")
    boosted = fused.join(e, "id").withColumn("s", F.round(F.col("score") * (1 + 1 / (1 + F.exp(-F.col("tau_initial") / 60))), 4)).select("query_id", "id", "prefix", "s")
    best = R.dedup_best(boosted, ["query_id", "prefix"], F.col("s"), "id")
    return R.top_k(best, ["query_id"], "s", "id", 10).select("query_id", "id", F.least(F.lit(1.0), "s").alias("score"), "rank")


KNN_SQL = f"""(SELECT a.vec_id AS query_id, b.vec_id AS id, round({COS_SQL}, 6)::DOUBLE AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)"""


@query(f"SELECT query_id, id, score FROM {KNN_SQL} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10")
def v2_knn_cosine(spark, sf_dir):
    return nearest(*vectors(spark, sf_dir)).select("query_id", "id", "score")


@query("""SELECT query_id, id, distance FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 6)::DOUBLE AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 10""")
def v1_knn_l2(spark, sf_dir):
    found = nearest(*vectors(spark, sf_dir), metric="l2")
    return found.select("query_id", "id", F.abs(F.col("score")).alias("distance"))


@query(f"SELECT query_id, k.id, round(score, 4)::DOUBLE AS score, tau_initial FROM (SELECT * FROM {KNN_SQL} WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20) k LEFT JOIN {EPISODES_SQL} e ON e.id = k.id")
def v4_vector_channel(spark, sf_dir):
    """Similarity to distance and back cancels out: the score is the cosine where positive."""
    e = episodes(spark, sf_dir).select("id", "tau_initial")
    k = nearest(*vectors(spark, sf_dir), k=20).where("score > 0")
    return k.join(e, "id", "left").select("query_id", "id", F.round("score", 4).alias("score"), "tau_initial")


@query(f"""SELECT query_id, k.id, round(greatest(0, 1 - distance / 2), 6)::DOUBLE AS score FROM (SELECT query_id, id, distance FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 6)::DOUBLE AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 20) k JOIN {EPISODES_SQL} e ON e.id = k.id WHERE NOT archived""")
def v5_direct_vector_search(spark, sf_dir):
    """The score falls with half the squared distance; archived episodes go."""
    e = episodes(spark, sf_dir).where("NOT archived").select("id")
    found = nearest(*vectors(spark, sf_dir), k=20, metric="l2").join(e, "id")
    return found.select("query_id", "id", F.round(F.greatest(F.lit(0.0), 1 + F.col("score") / 2), 6).alias("score"))


@query(f"SELECT query_id, id, round(1 / (1 + (CASE WHEN score > 0 THEN greatest(0, 1 / score - 1) END)), 4)::DOUBLE AS score FROM (SELECT * FROM {KNN_SQL} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10) WHERE score > 0")
def v3_similarity_mapping(spark, sf_dir):
    d = F.greatest(F.lit(0.0), 1 / F.col("score") - 1)
    return nearest(*vectors(spark, sf_dir)).where("score > 0").select("query_id", "id", F.round(1 / (1 + d), 4).alias("score"))


HYPER_SQL = f"""WITH s AS (SELECT query_id, id, score, 'vector' AS via FROM {KNN_SQL} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5),
m AS (SELECT DISTINCT l_orderkey AS h, l_partkey AS id FROM lineitem), x AS (SELECT s.query_id, b.id, round(max(s.score) * 0.8, 6)::DOUBLE AS score, 'hyperedge' AS via FROM s JOIN m a ON a.id = s.id JOIN m b ON b.h = a.h AND b.id <> s.id GROUP BY s.query_id, b.id)"""


@query(f"{HYPER_SQL} SELECT * FROM s UNION ALL SELECT * FROM x")
def v6_hypergraph_channel(spark, sf_dir):
    seeds = nearest(*vectors(spark, sf_dir), k=5).select("query_id", "id", "score", F.lit("vector").alias("via"))
    m = members(spark, sf_dir)
    edges = m.withColumnRenamed("episode_id", "id").join(seeds, "id").select("hyperedge_id", "query_id", F.col("id").alias("seed"), "score")
    near = edges.join(m, "hyperedge_id").where("episode_id != seed").groupBy("query_id", F.col("episode_id").alias("id")).agg(F.round(F.max("score") * 0.8, 6).alias("score"))
    return seeds.union(near.select("query_id", "id", "score", F.lit("hyperedge").alias("via")))


def tfidf_sql(asked: str, k: int = 20) -> str:
    """Common tables of the cosine; ``z`` has the ``k`` best of each query (query_id, text)."""
    return f"""dt AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({GRAMS_SQL}) AS term FROM documents) GROUP BY ALL), dn AS (SELECT count(*) AS n FROM documents),
di AS MATERIALIZED (SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM dt, dn GROUP BY term), dl AS (SELECT id, sqrt(sum(tf * idf * tf * idf)) AS norm FROM dt JOIN di USING (term) GROUP BY id),
qt AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({GRAMS_SQL}) AS term FROM ({asked})) GROUP BY ALL), qw AS (SELECT query_id, term, tf * idf AS w, idf FROM qt JOIN di USING (term)), ql AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
zs AS (SELECT query_id, id, round(sum(w * tf * idf) / (any_value(dl.norm) * any_value(ql.norm)), 6)::DOUBLE AS score FROM qw JOIN dt USING (term) JOIN dl USING (id) JOIN ql USING (query_id) GROUP BY query_id, id),
z AS (SELECT * FROM zs WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {k})"""


@query(f"WITH {tfidf_sql(QUESTIONS_SQL)} SELECT query_id, id, score FROM z")
def v10_tfidf_cosine(spark, sf_dir):
    """Cosine of character 2- to 4-grams within words: all benchmark items against all documents."""
    return tfidf_cosine(questions(spark, sf_dir), documents(spark, sf_dir)).select("query_id", "id", "score")


#: What the cascade is asked: every hundredth document's beginning. A level's results count from this score on.
CASCADE = {"shared": 2, "vector": 0.37, "grams": 0.4}
ASKED_SQL = "SELECT doc_id AS query_id, left(text, 40) AS text FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL"


@query(f"""WITH asked AS ({ASKED_SQL}), m AS (SELECT DISTINCT l_orderkey AS h, l_partkey AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'),
one AS (SELECT query_id, b.id, (count(*) / 10)::DOUBLE AS score, 1 AS tier FROM asked JOIN m a ON a.id = query_id JOIN m b ON b.h = a.h AND b.id <> a.id GROUP BY query_id, b.id HAVING count(*) >= {CASCADE["shared"]}),
two AS (SELECT query_id, id, score, 2 AS tier FROM (SELECT * FROM {KNN_SQL} WHERE id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10) WHERE score >= {CASCADE["vector"]} AND query_id IN (SELECT query_id FROM asked) AND query_id NOT IN (SELECT query_id FROM one)),
{tfidf_sql("SELECT * FROM asked")}, three AS (SELECT query_id, id, score, 3 AS tier FROM z WHERE score >= {CASCADE["grams"]} AND query_id NOT IN (SELECT query_id FROM one UNION ALL SELECT query_id FROM two)),
four AS (SELECT query_id, doc_id, 0.5::DOUBLE, 4 FROM asked JOIN documents d ON contains(lower(d.text), lower(asked.text)) WHERE query_id NOT IN (SELECT query_id FROM one UNION ALL SELECT query_id FROM two UNION ALL SELECT query_id FROM three))
SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three UNION ALL SELECT * FROM four""")
def v12_cascade(spark, sf_dir):
    """Hyperedges, vectors, grams, then the text itself: each level is asked only what the ones before found nothing for."""
    d = documents(spark, sf_dir)
    ws = Workspace(spark, "cascade")
    asked = ws.save(d.where("id % 100 = 0 AND text IS NOT NULL").select(F.col("id").alias("query_id"), F.substring("text", 1, 40).alias("text")), "asked")
    finished = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("hyperedge_id"))
    m = members(spark, sf_dir).join(finished, "hyperedge_id", "left_semi").withColumnRenamed("episode_id", "id")
    vectors_ = vectors(spark, sf_dir)[1]

    def shared(q):
        edges = m.join(q.select(F.col("query_id").alias("id")), "id").select(F.col("id").alias("query_id"), "hyperedge_id")
        near = edges.join(m, "hyperedge_id").where("id <> query_id").groupBy("query_id", "id").agg(F.count("*").alias("n"))
        return near.where(F.col("n") >= CASCADE["shared"]).select("query_id", "id", (F.col("n") / 10).alias("score"))

    def alike(q):
        own = q.select(F.col("query_id").alias("id")).join(vectors_, "id").select(F.col("id").alias("query_id"), "vector")
        return nearest(own, vectors_, itself=False).where(F.col("score") >= CASCADE["vector"]).select("query_id", "id", "score")

    def grams(q):
        return tfidf_cosine(q, d, least=CASCADE["grams"]).select("query_id", "id", "score")

    def text(q):
        return X.text_fallback(q.withColumnRenamed("text", "phrase"), d)

    return R.fall_through(asked, [shared, alike, grams, text], ws)


@query("SELECT query_id, doc_id AS id, 0.5::DOUBLE AS score FROM (SELECT doc_id AS query_id, left(text, 40) AS phrase FROM documents WHERE doc_id % 100 = 0) JOIN documents ON contains(lower(text), lower(phrase))")
def v11_text_fallback(spark, sf_dir):
    d = documents(spark, sf_dir)
    return X.text_fallback(d.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.substring("text", 1, 40).alias("phrase")), d)


#: Twenty consecutive documents are a community; its summary is the beginnings of the first five.
COMMUNITY_SQL = """(SELECT doc_id // 20 AS community, string_agg(left(text, 100), ' ' ORDER BY doc_id) AS text FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) <= 5) GROUP BY 1)"""
HITS_SQL = "SELECT query_id, id, score FROM (SELECT * FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)"
RELEVANCE_SQL = gram_bm25_sql("SELECT DISTINCT query_id, query_id AS corpus, text FROM top JOIN benchmark ON item_id = query_id WHERE place <= 5", f"SELECT DISTINCT query_id AS corpus, community AS id, c.text FROM top JOIN {COMMUNITY_SQL} c ON c.community = top.id // 20 WHERE place <= 5")
RELEVANCE_SQL = f"{BM25_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM ({HITS_SQL})), {RELEVANCE_SQL}"


def _community_hits(spark, sf_dir):
    """Ten best of each question, the communities of its five best, and how relevant each is to the question among those."""
    q, d = questions(spark, sf_dir), documents(spark, sf_dir).where("text IS NOT NULL")
    hits = Workspace(spark, "communities").save(X.bm25(q, d).select("query_id", "id", "score", "rank"), "hits")
    seeds = hits.where("rank <= 5").select("query_id", F.floor(F.col("id") / 20).alias("community")).distinct()
    number = F.floor(F.col("id") / 20)
    first = keep_last(d.select(number.alias("community"), "id", F.substring("text", 1, 100).alias("t")), ["community"], [F.col("id")], 5)
    summaries = first.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "t"))), lambda x: x["t"]), " ").alias("text"))
    corpora = seeds.join(summaries, "community").select(F.col("query_id").alias("corpus"), F.col("community").alias("id"), "text")
    score = X.gram_bm25(q.withColumn("corpus", F.col("query_id")), corpora, "corpus")
    return hits, score.select("query_id", F.col("id").alias("community"), F.round(F.col("score") / (1 + F.col("score")), 6).alias("relevance"))


@query(f"{RELEVANCE_SQL} SELECT query_id, id AS community, round(score / (1 + score), 6)::DOUBLE AS relevance FROM g")
def v16_community_relevance(spark, sf_dir):
    """BM25 of the question among the summaries of its own candidate communities, squashed to b / (1 + b)."""
    return _community_hits(spark, sf_dir)[1]


@query(f"""{RELEVANCE_SQL}, least AS (SELECT query_id, min(score) AS s FROM top WHERE place <= 5 GROUP BY 1), rel AS (SELECT query_id, id AS community, round(score / (1 + score), 6) AS relevance FROM g WHERE round(score / (1 + score), 6) >= 0.5),
mem AS (SELECT doc_id, doc_id // 20 AS community FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) <= 10)
SELECT query_id, doc_id AS id, round(relevance * s * 0.6, 6)::DOUBLE AS score FROM rel JOIN least USING (query_id) JOIN mem USING (community) WHERE (query_id, doc_id) NOT IN (SELECT (query_id, id) FROM top)""")
def v15_community_expansion(spark, sf_dir):
    """Five best results lead to their communities; those relevant enough add up to ten members that aren't results yet, below the weakest seed."""
    hits, relevance = _community_hits(spark, sf_dir)
    least = hits.where("rank <= 5").groupBy("query_id").agg(F.min("score").alias("s"))
    ids = documents(spark, sf_dir).select(F.floor(F.col("id") / 20).alias("community"), "id")
    members_ = keep_last(ids, ["community"], [F.col("id")], 10)
    found = relevance.where("relevance >= 0.5").join(least, "query_id").join(members_, "community").join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return found.select("query_id", "id", F.round(F.col("relevance") * F.col("s") * 0.6, 6).alias("score"))


@query(f"{RELEVANCE_SQL} SELECT query_id, id AS community, 'Community ' || id || ': ' || c.text AS content, round(round(score / (1 + score), 6) * least(0.4, 0.95 * 0.6), 6)::DOUBLE AS score FROM g JOIN {COMMUNITY_SQL} c ON c.community = g.id WHERE round(score / (1 + score), 6) >= 0.5")
def v17_synthesis(spark, sf_dir):
    """The summaries of relevant communities become results of their own, five at most since seeds are five."""
    _, relevance = _community_hits(spark, sf_dir)
    d = documents(spark, sf_dir).select(F.floor(F.col("id") / 20).alias("community"), "id", F.substring("text", 1, 100).alias("t")).where("t IS NOT NULL")
    first = keep_last(d, ["community"], [F.col("id")], 5).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "t"))), lambda x: x["t"]), " ").alias("text"))
    found = relevance.where("relevance >= 0.5").join(first, "community")
    boost = min(0.4, 0.95 * 0.6)
    return found.select("query_id", "community", F.concat(F.lit("Community "), "community", F.lit(": "), "text").alias("content"), F.round(F.col("relevance") * boost, 6).alias("score"))


@query("""WITH v AS (SELECT vec_id, list_transform(range(48), lambda j: list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * ((i * 31 + j * 17 + i * j) % 101 - 50) / 400))) AS e FROM embeddings)
SELECT query_id, id, round(0.6 / (1 + distance), 6)::DOUBLE AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) ** 2)), 6) AS distance FROM v a JOIN v b ON a.vec_id % 100 = 0)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 5""")
def v18_visual_recall(spark, sf_dir):
    """Text vectors projected to the visual space by a fixed matrix, then nearest neighbours; the encoder is a plug-in."""
    i = F.sequence(F.lit(0), F.lit(63))
    project = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda j: F.aggregate(F.zip_with("vector", i, lambda x, k: x.cast("double") * ((k * 31 + j * 17 + k * j) % 101 - 50) / 400), F.lit(0.0), lambda s, x: s + x))
    q, rows = vectors(spark, sf_dir)
    found = nearest(q.select("query_id", project.alias("vector")), rows.select("id", project.alias("vector")), k=5, metric="l2")
    return found.select("query_id", "id", F.round(0.6 / (1 - F.col("score")), 6).alias("score"))


@query(f"""SELECT o_orderkey AS query_id, attr_name, value, round(0.9 * 0.6, 6)::DOUBLE AS score FROM (SELECT o_orderkey, o_custkey % 150 AS entity_id FROM orders WHERE o_orderkey % 100 = 0) q JOIN (SELECT * FROM {VERSIONS_SQL} WHERE valid_from <= TIMESTAMP '2024-01-15' AND (expired_at IS NULL OR expired_at > TIMESTAMP '2024-01-15') QUALIFY row_number() OVER (PARTITION BY entity_id, attr_name ORDER BY valid_from DESC, id DESC) = 1) v USING (entity_id)
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY attr_name) <= 5""")
def v19_property_recall(spark, sf_dir):
    q = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 150).alias("entity_id"))
    v = as_of(property_versions(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return keep_last(q.join(v, "entity_id"), ["query_id"], [F.col("attr_name")], 5).select("query_id", "attr_name", "value", F.lit(0.54).alias("score"))


PROPER_SQL = "regexp_extract_all(text, '([A-Z][a-z]+(?:\\s[A-Z][a-z]+)*)', 1)"


@query(f"""{BM25_SQL}, seeds AS (SELECT query_id, max(score) AS s FROM r WHERE score > 0 GROUP BY 1), qn AS (SELECT DISTINCT item_id AS query_id, unnest({PROPER_SQL}[1:3]) AS name FROM benchmark), hn AS (SELECT doc_id AS id, unnest(list_distinct({PROPER_SQL})) AS name FROM documents),
t AS (SELECT qn.query_id, qn.name, e.id, e.created_at FROM qn JOIN hn USING (name) JOIN {EPISODES_SQL} e USING (id) WHERE length(qn.name) > 3 AND e.created_at <= TIMESTAMP '2024-01-01 10:00:00' AND NOT e.archived QUALIFY row_number() OVER (PARTITION BY qn.query_id, qn.name ORDER BY created_at DESC, e.id) <= 10)
SELECT DISTINCT query_id, id, created_at, round(0.9 * s, 6)::DOUBLE AS score FROM t JOIN seeds USING (query_id)""")
def v20_entity_expansion(spark, sf_dir):
    """The ten newest episodes, not archived, that name each of a question's first three names; they stand just below its best seed."""
    names = F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)"), F.lit(1))
    asked, d = questions(spark, sf_dir), documents(spark, sf_dir)
    q = asked.select("query_id", F.explode(F.slice(names, 1, 3)).alias("name")).where("length(name) > 3").distinct()
    held = d.select("id", F.explode(F.array_distinct(names)).alias("name"))
    e = episodes(spark, sf_dir).where("NOT archived").select("id", "created_at").where(F.col("created_at") <= F.lit("2024-01-01 10:00:00").cast("timestamp"))
    hits = keep_last(held.join(q, "name").join(e, "id"), ["query_id", "name"], [F.desc("created_at"), F.col("id")], 10)
    seeds = X.bm25(asked, d).groupBy("query_id").agg(F.max("score").alias("s"))
    return hits.join(seeds, "query_id").select("query_id", "id", "created_at", F.round(0.9 * F.col("s"), 6).alias("score")).distinct()


@query("""WITH s AS (SELECT DISTINCT p_partkey AS seed, p_brand AS term FROM part WHERE p_partkey % 50 = 0)
SELECT seed, schema_name, support, 0.45::DOUBLE AS score FROM (SELECT seed, p_type AS schema_name, count(*) AS support FROM s JOIN part ON p_brand = term GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY support DESC, schema_name) <= 3""")
def v22_schema_recall(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    schemas = p.groupBy(F.col("p_brand").alias("term"), F.col("p_type").alias("schema_name")).agg(F.count("*").alias("support"))
    seeds = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("seed"), F.col("p_brand").alias("term"))
    return keep_last(seeds.join(schemas, "term"), ["seed"], [F.desc("support"), F.col("schema_name")], 3).select("seed", "schema_name", "support", F.lit(0.45).alias("score"))


@query(f"SELECT seed, id, round(1 / (1 + n)::DOUBLE * 0.5 * 0.8, 6)::DOUBLE AS score FROM {COMEMBERS_SQL} QUALIFY row_number() OVER (PARTITION BY seed ORDER BY n DESC, id) <= 20")
def v23_graph_expansion(spark, sf_dir):
    top = keep_last(co_members(spark, sf_dir), ["seed"], [F.desc("n"), F.col("id")], 20)
    return top.select("seed", "id", F.round(1 / (1 + F.col("n")) * 0.5 * 0.8, 6).alias("score"))


ANSWERS_SQL = "SELECT item_id AS query_id, c.text FROM benchmark JOIN conversations c ON conv_id = item_id WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY turn) = 1"


@query(f"SELECT query_id, id, max(score)::DOUBLE AS score FROM (SELECT * FROM ({BM25_SQL} SELECT query_id, id, score FROM r {TEN}) UNION ALL SELECT * FROM ({bm25_sql(ANSWERS_SQL)} SELECT query_id, id, score FROM r {TEN})) GROUP BY ALL")
def v24_hypothesis_retrieval(spark, sf_dir):
    """Dual mode: the question and a hypothetical answer retrieve, the better score stays. The answer is a column that a model fills; here the first
    turn that an assistant gave in the conversation of the question's id. A question without one retrieves alone."""
    q, d = questions(spark, sf_dir), documents(spark, sf_dir)
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("query_id"), "turn", "text")
    answers = keep_last(said, ["query_id"], [F.col("turn")], 1).join(q.select("query_id"), "query_id", "left_semi").select("query_id", "text")
    forms = q.select((2 * F.col("query_id")).alias("query_id"), "text").union(answers.select(2 * F.col("query_id") + 1, "text"))  # both in one pass over the documents
    return X.bm25(forms, d).groupBy(F.floor(F.col("query_id") / 2).alias("query_id"), "id").agg(F.max("score").alias("score"))


@query(f"SELECT query_id, count(DISTINCT id) AS n, max(score) > 0 AND (max(score) - min(score)) / max(score) >= 0.25 AND count(DISTINCT id) >= 3 AS enough FROM (SELECT * FROM {KNN_SQL} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 12) GROUP BY 1")
def v27_sufficiency(spark, sf_dir):
    return sufficient(nearest(*vectors(spark, sf_dir), k=12))


@query()
def v25_agentic_rounds(spark, sf_dir):
    """Up to three rounds of BM25: where results aren't enough and name three new anchors, those are asked for next. What no SQL says is held against a plain loop in tests."""
    d = documents(spark, sf_dir).where("text IS NOT NULL")
    return agentic(questions(spark, sf_dir), lambda q: X.bm25(q, d), d.withColumnRenamed("text", "content"), F.lit("2024-02-01 00:00:00").cast("timestamp"))


STOP_SQL = ", ".join(f"'{w.replace(chr(39), chr(39) * 2)}'" for w in T.QUERY_STOP + T.TIME_STOP)


ATTRIBUTES_SQL = " UNION ALL ".join(f"SELECT query_id, '{a}' AS x FROM t WHERE regexp_matches(lower(text), '\\b{a.replace('_', '[_ ]')}\\b')" for a in T.ATTRIBUTES)


@query(f"""WITH k AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {KNN_SQL} QUALIFY rank <= 5),
t AS (SELECT query_id, rank, replace(replace(text, '’', chr(39)), '‘', chr(39)) AS text, regexp_replace({contracted_sql("replace(replace(text, '’', chr(39)), '‘', chr(39))")}, '[À-ÖØ-öø-ÿ]', '_', 'g') AS plain FROM k JOIN documents ON doc_id = id WHERE text IS NOT NULL),
f AS (SELECT query_id, rank, list_filter(list_concat(regexp_extract_all(plain, '\\b({T.NAME})\\b', 1), regexp_extract_all(plain, '\\b([a-z]{{2,}})\\b', 1)), lambda x: lower(x) NOT IN ({STOP_SQL})) AS e FROM t),
u AS (SELECT query_id, rank, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM f), o AS (SELECT query_id, rank, lower(x) AS low, arg_min(x, i) AS x, min(i) AS i FROM u GROUP BY ALL),
five AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY i) <= 5), once AS (SELECT query_id, low, arg_min(x, rank * 100000000 + i) AS x, min(rank * 100000000 + i) AS i FROM five GROUP BY query_id, low), every AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i) <= 5),
a AS (SELECT query_id, string_agg(DISTINCT x, ',' ORDER BY x) AS attributes FROM ({ATTRIBUTES_SQL}) GROUP BY 1),
w AS (SELECT query_id, rank, lower(text) AS low, regexp_extract(text, '((?:19|20)\\d{{2}})', 1) AS year FROM t),
m AS (SELECT query_id, arg_min(CASE WHEN contains(low, 'today') THEN 'time:today' WHEN contains(low, 'yesterday') THEN 'time:yesterday' WHEN regexp_matches(low, '(last|previous) (year|month|week|day)') THEN 'time:last_' || regexp_extract(low, '(last|previous) (year|month|week|day)', 2)
 WHEN regexp_matches(low, 'earlier|yesterday') THEN 'time:1706659200' WHEN regexp_matches(low, 'last|previous') THEN 'time:1706659200' ELSE 'time:' || epoch(make_timestamp(year::BIGINT, 12, 31, 23, 59, 59.0))::BIGINT END, rank) AS time
 FROM w WHERE NOT regexp_matches(low, '{T.NEWEST}') AND (year <> '' OR regexp_matches(low, 'today|yesterday|earlier|last|previous')) GROUP BY 1)
SELECT query_id, string_agg(x, ',' ORDER BY i) AS entities, coalesce(any_value(attributes), '') AS attributes, coalesce(any_value(time), '') AS time FROM (SELECT DISTINCT query_id FROM t) LEFT JOIN every USING (query_id) LEFT JOIN a USING (query_id) LEFT JOIN m USING (query_id) GROUP BY query_id""")
def v28_anchors(spark, sf_dir):
    """What the five best results of each query name: entities, attribute words, a time."""
    hits = nearest(*vectors(spark, sf_dir), k=5).join(documents(spark, sf_dir).withColumnRenamed("text", "content"), "id").where("content IS NOT NULL")
    found = anchors(hits.select("query_id", "rank", "content"), F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return found.select("query_id", F.array_join("entities", ",").alias("entities"), F.array_join("attributes", ",").alias("attributes"), F.coalesce("time", F.lit("")).alias("time"))


@query(f"""SELECT query_id, id, round(CASE WHEN query_id % 300 = 0 THEN score * 0.9 WHEN bonus >= 0.95 THEN least(0.9999, score + 0.3) ELSE score * (0.2 + 0.8 * bonus) END, 6)::DOUBLE AS score FROM
(SELECT k.query_id, k.id, score, (CASE WHEN a.label = b.label THEN 1.0 ELSE 0.3 END) * least(1.0, tau_initial / 0.5) * 1.0 AS bonus FROM (SELECT * FROM {KNN_SQL} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10) k
JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = k.id JOIN {EPISODES_SQL} e ON e.id = k.id)""")
def v32_read_time_rescoring(spark, sf_dir):
    lab = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    e = episodes(spark, sf_dir).select("id", "tau_initial")
    k = nearest(*vectors(spark, sf_dir)).join(lab.toDF("query_id", "a"), "query_id").join(lab.toDF("id", "b"), "id").join(e, "id")
    bonus = F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.3) * F.least(F.lit(1.0), F.col("tau_initial") / 0.5)
    s = F.col("score")
    out = F.when(F.col("query_id") % 300 == 0, s * 0.9).when(bonus >= 0.95, F.least(F.lit(0.9999), s + 0.3)).otherwise(s * (0.2 + 0.8 * bonus))
    return k.select("query_id", "id", F.round(out, 6).alias("score"))


@query("SELECT p_brand AS community, 'Community ' || p_brand || ': ' || count(*) || ' members. ' || array_to_string((list(left(p_name, 100) ORDER BY p_partkey))[1:5], '; ') AS report FROM part GROUP BY p_brand")
def v35_template_report(spark, sf_dir):
    first = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("p_partkey", F.substring("p_name", 1, 100).alias("t")))), 1, 5), lambda x: x["t"])
    p = keep_last(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_partkey")], 5).groupBy("p_brand").agg(first.alias("f"))
    n = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return n.join(p, "p_brand").select(F.col("p_brand").alias("community"), F.concat(F.lit("Community "), "p_brand", F.lit(": "), "n", F.lit(" members. "), F.array_join("f", "; ")).alias("report"))


@query(f"""WITH w AS (SELECT doc_id AS id, ('0x' || left(md5(term), 8))::BIGINT % 384 AS dim, count(*)::DOUBLE AS x FROM (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents) GROUP BY ALL)
SELECT id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6)::DOUBLE AS x FROM w""")
def v36_text_embedding(spark, sf_dir):
    """Fallback encoder: word counts hashed to 384 dimensions, unit length; the components of each vector that aren't 0."""
    d = documents(spark, sf_dir)
    bucket = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % 384
    w = d.select("id", F.explode(X.words(F.col("text"))).alias("w")).groupBy("id", bucket.alias("dim")).agg(F.count("*").cast("double").alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("id")))
    return w.select("id", "dim", F.round(F.col("x") / norm, 6).alias("x"))


INNER_SQL = "list_filter(list_slice(regexp_split_to_array(lower(text), '[^a-z0-9à-ÿ]+'), 2, -2), lambda x: length(x) > 1)"


@query(f"""{BM25_SQL}, k AS (SELECT query_id, id FROM r {TEN}),
truth AS (SELECT item_id AS query_id, doc_id AS id FROM (SELECT *, {INNER_SQL} AS inside FROM benchmark) b JOIN documents d ON contains(d.text, b.text) WHERE len(inside) > 0),
n AS (SELECT query_id, count(*) AS found FROM k GROUP BY 1), t AS (SELECT query_id, count(*) AS relevant, count(k.id) AS hits FROM truth LEFT JOIN k USING (query_id, id) GROUP BY 1)
SELECT query_id, round(hits / relevant::DOUBLE, 6)::DOUBLE AS recall, round(coalesce(hits / found::DOUBLE, 0), 6)::DOUBLE AS precision, round(coalesce(2 * hits / (relevant + found)::DOUBLE, 0), 6)::DOUBLE AS f1 FROM t LEFT JOIN n USING (query_id)""")
def a17_recall_at_k(spark, sf_dir):
    """Precision, recall and F1 of the ten best. Truth are documents that hold the item word for word: they hold the words inside it, so they are looked for under the rarest of those and then compared."""
    q, d = questions(spark, sf_dir), documents(spark, sf_dir)
    hits = Workspace(spark, "recall").save(X.bm25(q, d).select("query_id", "id"), "hits")
    pieces = F.split(F.lower(F.col("text")), r"[^a-z0-9à-ÿ]+")
    inside = F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda w: F.length(w) > 1)
    asked = q.select("query_id", F.col("text").alias("item"), F.explode(F.array_distinct(inside)).alias("term"))
    wanted = Workspace(spark, "recall").save(asked.select("term").distinct(), "wanted")
    held = d.select("id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("term")).join(F.broadcast(wanted) if within(wanted, 200_000) else wanted, "term", "left_semi")
    held = Workspace(spark, "recall").save(held, "held")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    rarest = asked.join(df, "term").groupBy("query_id").agg(F.min_by(F.struct("term", "item"), F.struct("df", "term")).alias("r")).select("query_id", "r.term", "r.item")
    truth = held.join(rarest, "term").join(d, "id").where(F.col("text").contains(F.col("item"))).select("query_id", "id")
    good = truth.join(hits.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("relevant"), F.count("hit").alias("hits"))
    n = good.join(hits.groupBy("query_id").agg(F.count("*").alias("found")), "query_id", "left")
    share = {"recall": F.col("hits") / F.col("relevant"), "precision": F.col("hits") / F.col("found"), "f1": 2 * F.col("hits") / (F.col("relevant") + F.col("found"))}
    return n.select("query_id", *(F.round(F.coalesce(x, F.lit(0.0)), 6).alias(name) for name, x in share.items()))


@query("""SELECT conv_id, round(coalesce(sum((turn >= before)::INT) / count(before)::DOUBLE, 1), 6)::DOUBLE AS accuracy FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations) GROUP BY 1""")
def a17_temporal_accuracy(spark, sf_dir):
    """Share of neighbouring memories of a session that stand in the order of their time; one alone is in order."""
    before = F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", before.alias("before"))
    right = F.sum((F.col("turn") >= F.col("before")).cast("int")) / F.count("before")
    return c.groupBy("conv_id").agg(F.round(F.coalesce(right, F.lit(1.0)), 6).alias("accuracy"))


PROBE_SQL = f"SELECT id AS query_id, left(content, 40) AS text FROM (SELECT * FROM {EPISODES_SQL} WHERE NOT archived AND content IS NOT NULL ORDER BY tau_initial DESC, id LIMIT 30)"


@query(f"{bm25_sql(PROBE_SQL)}, k AS (SELECT query_id, id FROM r {TEN}) SELECT (SELECT count(*) FROM ({PROBE_SQL})) AS probes, round((SELECT count(*) FROM k WHERE id = query_id) / 30.0, 6)::DOUBLE AS recall")
def a18_health_probe(spark, sf_dir):
    """The 30 strongest episodes ask for themselves by their own first words; recall at 10."""
    e = episodes(spark, sf_dir).where("NOT archived AND content IS NOT NULL").orderBy(F.desc("tau_initial"), "id").limit(30)
    probes = e.select(F.col("id").alias("query_id"), F.substring("content", 1, 40).alias("text"))
    hits = X.bm25(probes, documents(spark, sf_dir)).where("query_id = id").select("query_id", F.lit(1).alias("hit"))
    return probes.select("query_id").join(hits, "query_id", "left").agg(F.count("*").alias("probes"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
