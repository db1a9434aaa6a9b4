"""Consolidation: graphs, communities, patterns, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators.communities import louvain
from ..operators.consolidation import consolidate
from ..operators.hierarchy import judge_edges
from ..operators.strings import edit_pairs
from ..operators.temporal import keep_last
from ..shared import Workspace
from ..sources.tables import EPISODES_SQL, MEMBERS_SQL, episodes, members, table
from .catalog import query
from .retrieval import COS_SQL, KNN_SQL, vectors
from .temporal import TAU_SQL, _decayed

GRAPH_SQL = f"(SELECT a.vec_id AS query_id, b.vec_id AS id, round({COS_SQL}, 6)::DOUBLE AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)"
EDGES_SQL = f"(SELECT query_id AS src, id AS dst, score AS weight FROM {GRAPH_SQL} WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 6)"


def knn_graph(spark, sf_dir):
    return G.knn_edges(vectors(spark, sf_dir)[1])


@query(f"SELECT * FROM {EDGES_SQL}")
def m9_knn_graph(spark, sf_dir):
    """Edges to the six nearest others, from 0.3 on: what an index rebuild writes."""
    return knn_graph(spark, sf_dir)


@query(f"SELECT src, count(*) AS degree, round(sum(weight), 4)::DOUBLE AS strength FROM {EDGES_SQL} GROUP BY src")
def g12_edge_seeding(spark, sf_dir):
    return knn_graph(spark, sf_dir).groupBy("src").agg(F.count("*").alias("degree"), F.round(F.sum("weight"), 4).alias("strength"))


@query(f"""WITH k AS (SELECT 'episode' AS kind, 'order-' || hyperedge_id AS topic, episode_id, source FROM {MEMBERS_SQL} JOIN {EPISODES_SQL} e ON e.id = episode_id
UNION ALL SELECT 'temporal', source || '@' || strftime(created_at, '%Y-%m-%d %H'), id, source FROM {EPISODES_SQL} UNION ALL SELECT 'community', 'community-' || (id // 20), id, source FROM {EPISODES_SQL})
SELECT kind, topic, count(DISTINCT episode_id) AS size, min(episode_id) AS first_member, count(DISTINCT source) >= 2 AS several_agents FROM k GROUP BY kind, topic HAVING count(DISTINCT episode_id) >= 2""")
def g1_hyperedges(spark, sf_dir):
    """Hyperedges of three kinds: members of an order, episodes of one source in one hour, and communities of twenty; two members at least. Those whose members come from two sources or more are shared between agents."""
    every = hyperedge_members(spark, sf_dir)
    return every.groupBy("kind", "topic").agg(F.countDistinct("id").alias("size"), F.min("id").alias("first_member"), (F.countDistinct("source") >= 2).alias("several_agents")).where("size >= 2")


def hyperedge_members(spark, sf_dir):
    """``kind, topic, id, source``: which episodes belong together."""
    e = episodes(spark, sf_dir).select("id", "source", "created_at")
    of_order = members(spark, sf_dir).join(e, F.col("episode_id") == F.col("id")).select(F.lit("episode").alias("kind"), F.concat(F.lit("order-"), "hyperedge_id").alias("topic"), "id", "source")
    of_hour = e.select(F.lit("temporal"), F.concat("source", F.lit("@"), F.date_format("created_at", "yyyy-MM-dd HH")), "id", "source")
    of_community = e.select(F.lit("community"), F.concat(F.lit("community-"), F.floor(F.col("id") / 20)), "id", "source")
    return of_order.union(of_hour).union(of_community).where("topic IS NOT NULL")


@query("""SELECT src, dst, max(weight)::DOUBLE AS weight FROM (SELECT l_orderkey AS src, l_orderkey + 1 AS dst, 0.01 * l_linenumber AS weight FROM lineitem WHERE l_linenumber = 1 UNION ALL
SELECT a.o_orderkey, b.o_orderkey, 0.15 FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderpriority = b.o_orderpriority) GROUP BY ALL""")
def g2_similarity_graph(spark, sf_dir):
    """Stored edges and an edge for each pair of one type; the pairs come from an equi-join on customer and priority."""
    stored = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("src"), (F.col("l_orderkey") + 1).alias("dst"), (0.01 * F.col("l_linenumber")).alias("weight"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    pairs = o.withColumnRenamed("o_orderkey", "src").join(o.withColumnRenamed("o_orderkey", "dst"), ["o_custkey", "o_orderpriority"]).where("src < dst")
    return stored.union(pairs.select("src", "dst", F.lit(0.15))).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM {EDGES_SQL} UNION SELECT dst, src FROM {EDGES_SQL}),
r(node, low) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, r.low FROM r JOIN e ON e.src = r.node AND r.low < e.dst)
SELECT node, min(low) AS component FROM r GROUP BY node""")
def g3_connected_components(spark, sf_dir):
    return G.connected_components(knn_graph(spark, sf_dir))


def propagation_sql(rounds: int = 5) -> str:
    """Each round as common tables of its own: votes by weight, the smaller label on a tie."""
    steps = [f"""v{k} AS MATERIALIZED (SELECT e.src AS id, l.label, round(sum(e.weight), 9) AS w FROM e JOIN l{k} l ON l.id = e.dst GROUP BY ALL),
l{k + 1} AS MATERIALIZED (SELECT id, label FROM v{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1)""" for k in range(rounds)]
    return f"WITH k AS MATERIALIZED (SELECT * FROM {EDGES_SQL}), e AS MATERIALIZED (SELECT * FROM k UNION ALL SELECT dst, src, weight FROM k), l0 AS (SELECT DISTINCT src AS id, src AS label FROM e), {', '.join(steps)} SELECT id, label FROM l{rounds}"


@query(propagation_sql())
def g4_label_propagation(spark, sf_dir):
    return G.label_propagation(knn_graph(spark, sf_dir))


@query()
def g4_louvain(spark, sf_dir):
    """Communities of the neighbour graph by modularity, in levels. What no SQL says is held against a plain version in tests."""
    return louvain(knn_graph(spark, sf_dir))


KINDS_SQL = f"""(SELECT 'episode' AS kind, 'order-' || hyperedge_id AS topic, episode_id AS id, source FROM {MEMBERS_SQL} JOIN {EPISODES_SQL} e ON e.id = episode_id
UNION ALL SELECT 'temporal', source || '@' || strftime(created_at, '%Y-%m-%d %H'), id, source FROM {EPISODES_SQL} UNION ALL SELECT 'community', 'community-' || (id // 20), id, source FROM {EPISODES_SQL})"""


@query(f"""SELECT 'node' AS row, md5(kind || '|' || topic) AS edge, kind, topic, -1::BIGINT AS member, count(DISTINCT id) AS size FROM {KINDS_SQL} WHERE topic IS NOT NULL GROUP BY kind, topic HAVING count(DISTINCT id) >= 2
UNION ALL SELECT DISTINCT 'member', md5(kind || '|' || topic), kind, topic, id, count(DISTINCT id) OVER (PARTITION BY kind, topic) AS size FROM {KINDS_SQL} WHERE topic IS NOT NULL QUALIFY size >= 2""")
def g1_hyperedge_rows(spark, sf_dir):
    """What creating the hyperedges writes: a node a hyperedge, named by its kind and topic so that a second run adds none, and an edge a member (a node names none: -1). Members are counted by an aggregate that joins back, so no list is built."""
    every = hyperedge_members(spark, sf_dir).select("kind", "topic", "id").distinct()
    sized = every.groupBy("kind", "topic").agg(F.count("*").alias("size")).where("size >= 2").withColumn("edge", F.md5(F.concat_ws("|", "kind", "topic")))
    nodes = sized.select(F.lit("node").alias("row"), "edge", "kind", "topic", F.lit(-1).cast("long").alias("member"), "size")
    return nodes.union(every.join(sized, ["kind", "topic"]).select(F.lit("member"), "edge", "kind", "topic", "id", "size"))


@query(f"SELECT id, round(tau_initial * 1.0, 6)::DOUBLE AS strength FROM {EPISODES_SQL} WHERE NOT quarantine")
def g5_gather(spark, sf_dir):
    return episodes(spark, sf_dir).where("NOT quarantine").select("id", F.round(F.col("tau_initial") * 1.0, 6).alias("strength"))


@query(f"""WITH p AS (SELECT a.episode_id AS src, b.episode_id AS dst, sum((a.episode_id % 10) / 10.0 * (b.episode_id % 10) / 10.0) AS x FROM {MEMBERS_SQL} a JOIN {MEMBERS_SQL} b ON a.hyperedge_id = b.hyperedge_id AND a.episode_id < b.episode_id WHERE a.episode_id % 10 >= 3 AND b.episode_id % 10 >= 3 GROUP BY ALL),
o AS (SELECT p_partkey AS src, p_partkey + 1 AS dst, 0.5 AS w FROM part), u AS (SELECT coalesce(p.src, o.src) AS src, coalesce(p.dst, o.dst) AS dst, round(coalesce(w, 0) + 0.1 * coalesce(x, 0) - CASE WHEN x IS NOT NULL THEN 0.001 * coalesce(w, 0) ELSE 0 END, 6)::DOUBLE AS weight FROM p FULL JOIN o ON p.src = o.src AND p.dst = o.dst)
SELECT src, dst, weight FROM u QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 8""")
def g11_hebbian_update(spark, sf_dir):
    """Pairs that are active together gain weight, old edges leak, each node keeps its eight strongest."""
    m = members(spark, sf_dir).where("episode_id % 10 >= 3")
    a, b = m.withColumnRenamed("episode_id", "src"), m.withColumnRenamed("episode_id", "dst")
    act = lambda c: F.col(c) % 10 / 10
    pairs = a.join(b, "hyperedge_id").where("src < dst").groupBy("src", "dst").agg(F.sum(act("src") * act("dst")).alias("x"))
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"), F.lit(0.5).alias("w"))
    zero = F.lit(0.0)
    w = F.coalesce("w", zero) + 0.1 * F.coalesce("x", zero) - F.when(F.col("x").isNotNull(), 0.001 * F.coalesce("w", zero)).otherwise(0.0)
    new = pairs.join(old, ["src", "dst"], "full").select("src", "dst", F.round(w, 6).alias("weight"))
    return keep_last(new, ["src"], [F.desc("weight"), F.col("dst")], 8)


def token_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("items"))


SETS_SQL = "(SELECT doc_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM documents WHERE text IS NOT NULL)"


def similar_sql(least: float) -> str:
    """Pairs x < y of documents with words whose sets overlap that much, equal ones included."""
    return f"""s AS MATERIALIZED (SELECT id, w, len(w) AS n FROM {SETS_SQL} WHERE len(w) > 0),
p AS MATERIALIZED (SELECT x, y, c / (m + n - c)::DOUBLE AS similarity FROM (SELECT a.id AS x, b.id AS y, a.n AS m, b.n AS n, len(list_intersect(a.w, b.w)) AS c FROM s a JOIN s b ON a.id < b.id AND least(a.n, b.n) >= {least} * greatest(a.n, b.n)) WHERE c / (m + n - c)::DOUBLE >= {least})"""


REACH_SQL = "e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p), r(node, low) AS (SELECT id, id FROM s UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.node AND r.low < e.y), k AS (SELECT node AS id, min(low) AS component FROM r GROUP BY node)"


@query(f"WITH RECURSIVE {similar_sql(0.75)}, {REACH_SQL} SELECT id, component FROM k")
def a4_near_duplicate_evidence(spark, sf_dir):
    """Documents whose word sets overlap by 0.75 or more are one evidence, named by the smallest id that such links reach."""
    return G.jaccard_groups(token_sets(spark, sf_dir), 0.75)


@query(f"WITH {similar_sql(0.8)}, twin AS (SELECT DISTINCT y AS id FROM p WHERE similarity = 1) SELECT x AS a, y AS b, round(similarity, 6)::DOUBLE AS similarity FROM p WHERE x NOT IN (SELECT id FROM twin) AND y NOT IN (SELECT id FROM twin)")
def j12_similar_in_group(spark, sf_dir):
    """Pairs of different word sets, each set standing for its copies by the smallest id."""
    return G.jaccard_pairs(token_sets(spark, sf_dir), 0.8)


@query(f"WITH RECURSIVE {similar_sql(0.8)}, {REACH_SQL}, b AS (SELECT component, arg_max(id, ((id * 37) % 100) * 1000000000 - id) AS winner FROM k GROUP BY 1) SELECT id AS loser, winner FROM k JOIN b USING (component) WHERE id <> winner")
def g14_merge_conflicts(spark, sf_dir):
    """Similar documents merge: the lower tau into the higher, by components so the order of pairs doesn't matter."""
    return G.merge_order(G.jaccard_groups(token_sets(spark, sf_dir), 0.8), (F.col("id") * 37) % 100)


@query(f"""WITH RECURSIVE {similar_sql(0.8)}, {REACH_SQL}, b AS (SELECT component, arg_max(id, ((id * 37) % 100) * 1000000000 - id) AS winner FROM k GROUP BY 1), f AS (SELECT winner, min(id) AS loser FROM k JOIN b USING (component) WHERE id <> winner GROUP BY winner)
SELECT winner, loser, left(w.text || ' | merged: ' || l.text, 2000) AS content FROM f JOIN documents w ON w.doc_id = winner JOIN documents l ON l.doc_id = loser""")
def g15_merge_content(spark, sf_dir):
    """What a winner of a merge holds afterwards: its own text and that of the first loser, up to 2,000 characters."""
    merges = G.merge_order(G.jaccard_groups(token_sets(spark, sf_dir), 0.8), (F.col("id") * 37) % 100)
    first = merges.groupBy("winner").agg(F.min("loser").alias("loser"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = first.join(d.toDF("winner", "own"), "winner").join(d.toDF("loser", "other"), "loser")
    return both.select("winner", "loser", F.substring(F.concat("own", F.lit(" | merged: "), "other"), 1, 2000).alias("content"))


@query("SELECT p_brand AS community, count(*) AS size, array_to_string((list(DISTINCT p_type ORDER BY p_type))[1:3], ',') AS topics, array_to_string((list(p_partkey ORDER BY p_partkey))[1:20], ',') AS episodes FROM part GROUP BY p_brand HAVING count(*) >= 2")
def g16_synthesise(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = lambda c, n: F.concat_ws(",", F.transform(F.slice(F.sort_array(c), 1, n), lambda x: x.cast("string")))
    first = keep_last(p, ["p_brand"], [F.col("p_partkey")], 20).groupBy("p_brand").agg(text(F.collect_list("p_partkey"), 20).alias("episodes"))
    g = p.groupBy("p_brand").agg(F.count("*").alias("size"), text(F.collect_set("p_type"), 3).alias("topics")).where("size >= 2")
    return g.join(first, "p_brand").select(F.col("p_brand").alias("community"), "size", "topics", "episodes")


@query("SELECT doc_id, array_to_string((list_filter(string_split(text, ' '), lambda x: x <> ''))[1:500], ' ') AS report FROM documents")
def g17_compress(spark, sf_dir):
    cut = F.slice(F.filter(F.split("text", " "), lambda x: x != ""), 1, 500)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(cut, " ").alias("report"))


@query("""WITH f AS (SELECT p_brand, avg(p_size / 50) AS a, avg(p_retailprice / 2000) AS b, least(1.0, count(*) / 100) AS n FROM part GROUP BY 1),
g AS (SELECT p_brand, (1 / (1 + exp(-0.488 * a)) + 1 / (1 + exp(-0.488 * b)) + 1 / (1 + exp(-0.488 * n))) / 3 AS gate FROM f)
SELECT p_brand AS community, round(gate, 6)::DOUBLE AS gate, (CASE WHEN gate > 0.95 THEN 0.55 WHEN gate < 0.05 THEN 0.45 ELSE 0.5 END)::DOUBLE AS confidence FROM g""")
def g18_state_space_consolidation(spark, sf_dir):
    """Three state-space steps over each community's features; confidence moves by a tenth where the gate saturates."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg(F.col("p_size") / 50).alias("a"), F.avg(F.col("p_retailprice") / 2000).alias("b"), F.count("*").alias("n"))
    x = F.array("a", "b", F.least(F.lit(1.0), F.col("n") / 100))
    step = lambda h, _: F.zip_with(h, x, lambda s, v: 0.8 * s + 0.2 * v)
    h = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), step)
    gate = F.aggregate(F.transform(h, lambda s: 1 / (1 + F.exp(-s))), F.lit(0.0), lambda t, s: t + s) / 3
    return p.select(F.col("p_brand").alias("community"), F.round(gate, 6).alias("gate"), F.when(gate > 0.95, 0.55).when(gate < 0.05, 0.45).otherwise(0.5).alias("confidence"))


@query(f"""SELECT id, round(c, 6)::DOUBLE AS confidence, c < 0.1 OR (c < 0.3 AND n >= 3) OR n >= 10 AS flagged FROM (SELECT id, id % 12 AS n, least(1.0, greatest(0.01, tau_initial * (CASE source_type WHEN 'direct' THEN 1.0 WHEN 'inferred' THEN 0.7 ELSE 0.4 END) * exp(-0.15 * (id % 12)))) AS c FROM {EPISODES_SQL})""")
def g19_calibrate_confidence(spark, sf_dir):
    n = F.col("id") % 12
    w = F.when(F.col("source_type") == "direct", 1.0).when(F.col("source_type") == "inferred", 0.7).otherwise(0.4)
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.01), F.col("tau_initial") * w * F.exp(-0.15 * n)))
    return episodes(spark, sf_dir).select("id", F.round(c, 6).alias("confidence"), ((c < 0.1) | ((c < 0.3) & (n >= 3)) | (n >= 10)).alias("flagged"))


@query("""WITH e AS (SELECT doc_id, list_concat(list_filter(list_transform(regexp_extract_all(text, '["「『“]([^"「『“”」』]{2,50})["」』”]', 1), lambda x: trim(x)), lambda x: length(x) >= 2),
 list_filter(regexp_extract_all(plain, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){0,3})\\b', 1), lambda x: lower(x) NOT IN ('this', 'that', 'the', 'what', 'when', 'where', 'which', 'there', 'these', 'those', 'then', 'than', 'also', 'with', 'from')),
 list_filter(regexp_extract_all(plain, '\\b([A-Z]{2,8})\\b', 1), lambda x: x NOT IN ('AI', 'API', 'I', 'II', 'III', 'IV', 'VI'))) AS names FROM (SELECT doc_id, text, regexp_replace(text, '[À-ÖØ-öø-ÿ]', '_', 'g') AS plain FROM documents) WHERE text IS NOT NULL)
SELECT doc_id, len(list_distinct(names))::INT AS n, array_to_string(list_sort(list_distinct(names)), ',') AS names FROM e""")
def g20_named_entities(spark, sf_dir):
    """Quoted strings, capitalised runs of one to four words and acronyms of every text, less the words that name nothing."""
    found = X.named_entities(F.col("text"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(found).alias("n"), F.array_join(found, ",").alias("names"))


@query("SELECT 'community' AS kind, count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT 'member', count(*) FROM part UNION ALL SELECT 'hyperedge', count(*) FROM (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 2)")
def g21_community_persist(spark, sf_dir):
    """Communities, members and one hyperedge per community are written as tables and read back."""
    ws = Workspace(spark, "communities")
    p = table(spark, sf_dir, "part")
    sized = ws.save(p.groupBy("p_brand").agg(F.count("*").alias("n")), "communities")
    m = ws.save(p.select("p_brand", "p_partkey"), "members")
    one = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return one(sized, "community").union(one(m, "member")).union(one(sized.where("n >= 2"), "hyperedge"))


@query("SELECT p_type AS proposal, count(DISTINCT p_brand) AS keys FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) >= 2 AND p_type NOT LIKE 'SMALL%' ORDER BY keys DESC, proposal LIMIT 1")
def g22_schema_evolution_guard(spark, sf_dir):
    """Proposals need two keys of their own and a new name; one a round."""
    g = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("proposal")).agg(F.countDistinct("p_brand").alias("keys"))
    return g.where((F.col("keys") >= 2) & ~F.col("proposal").startswith("SMALL")).orderBy(F.desc("keys"), "proposal").limit(1)


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0), q AS (SELECT p_partkey AS proposal, CASE WHEN p_partkey % 20 = 0 THEN p_partkey // 9 ELSE p_partkey + 1 END AS child, p_partkey AS parent FROM part WHERE p_partkey % 5 = 0),
u AS (SELECT proposal, parent AS node, 0 AS steps FROM q UNION ALL SELECT proposal, t.parent, steps + 1 FROM u JOIN t ON t.child = u.node WHERE steps < 9), d AS (SELECT proposal, child AS node, 0 AS steps FROM q UNION ALL SELECT proposal, t.child, steps + 1 FROM d JOIN t ON t.parent = d.node WHERE steps < 9),
x AS (SELECT proposal, child, parent, proposal IN (SELECT proposal FROM u WHERE u.node = q.child AND u.proposal = q.proposal) AS cyclic, least(9, (SELECT max(steps) FROM u WHERE u.proposal = q.proposal) + (SELECT max(steps) FROM d WHERE d.proposal = q.proposal) + 1)::INT AS depth FROM q)
SELECT *, NOT cyclic AND depth <= 8 AS accepted FROM x""")
def g22_hierarchy_guard(spark, sf_dir):
    """Proposed parents of types in a tree of parts: some would close a circle, some make it deeper than eight."""
    i = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey")
    tree = p.where(i > 0).select(i.alias("child"), F.floor(i / 3).alias("parent"))
    asked = p.where(i % 5 == 0).select(i.alias("proposal"), F.when(i % 20 == 0, F.floor(i / 9)).otherwise(i + 1).alias("child"), i.alias("parent"))
    return judge_edges(tree, asked, 8)


@query("SELECT DISTINCT regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS skill FROM part WHERE length(p_name) > 3")
def g23_skill_names(spark, sf_dir):
    return table(spark, sf_dir, "part").where("length(p_name) > 3").select(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-").alias("skill")).distinct()


@query("""WITH t AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z]{6,})', 1)) AS term FROM documents)), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1 HAVING count(*) >= 20),
s AS (SELECT doc_id, array_to_string((list(term ORDER BY term))[1:5], ' ') AS pattern FROM t JOIN f USING (term) GROUP BY doc_id)
SELECT pattern, count(*) AS support FROM s GROUP BY 1 HAVING count(*) >= 3""")
def a9_frequent_patterns(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1)))).alias("term"))
    f = t.groupBy("term").agg(F.count("*").alias("df")).where("df >= 20")
    s = t.join(f, "term").groupBy("doc_id").agg(F.array_join(F.slice(F.sort_array(F.collect_list("term")), 1, 5), " ").alias("pattern"))
    return s.groupBy("pattern").agg(F.count("*").alias("support")).where("support >= 3")


@query("SELECT l_suppkey AS entity, count(DISTINCT l_orderkey) AS nodes FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2")
def a10_entity_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(F.countDistinct("l_orderkey").alias("nodes")).where("nodes >= 2")


@query("""WITH RECURSIVE n AS MATERIALIZED (SELECT lower(p_name) AS name, count(*) AS n, min(p_partkey) AS id FROM part WHERE p_name IS NOT NULL GROUP BY 1),
e AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM n a JOIN n b ON a.id <> b.id AND abs(length(a.name) - length(b.name)) <= 2 AND levenshtein(a.name, b.name) <= 2),
r(id, low) AS (SELECT id, id FROM n UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.id AND r.low < e.y), k AS (SELECT id, min(low) AS cluster FROM r GROUP BY id)
SELECT cluster, sum(n)::BIGINT AS mentions, arg_max(name, n * 1000000000 + rank) AS canonical, least(1.0, sum(n) / 10)::DOUBLE AS confidence FROM (SELECT *, rank() OVER (ORDER BY name) AS rank FROM n JOIN k USING (id)) GROUP BY cluster HAVING sum(n) >= 2""")
def a11_mention_clusters(spark, sf_dir):
    """Names within two edits form clusters, through what deletions leave of them; the most frequent spelling is canonical, the last in order on a tie."""
    names = table(spark, sf_dir, "part").where("p_name IS NOT NULL").groupBy(F.lower("p_name").alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("id"))
    names = Workspace(spark, "mentions").save(names, "names")
    comps = G.connected_components(edit_pairs(names, 2), "a", "b").withColumnRenamed("node", "id")
    full = names.join(comps, "id", "left").withColumn("cluster", F.coalesce("component", "id"))
    g = full.groupBy("cluster").agg(F.sum("n").alias("mentions"), F.max(F.struct("n", "name")).alias("b"))
    return g.where("mentions >= 2").select("cluster", "mentions", F.col("b.name").alias("canonical"), F.least(F.lit(1.0), F.col("mentions") / 10).alias("confidence"))


@query("SELECT p_type || 'Discovered' AS name, p_type AS parent, count(*) AS entities FROM part GROUP BY p_type HAVING count(*) >= 2")
def a12_type_proposals(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("entities")).where("entities >= 2")
    return g.select(F.concat("p_type", F.lit("Discovered")).alias("name"), F.col("p_type").alias("parent"), "entities")


@query(f"""SELECT namespace AS community, round(avg(id % 10 / 10.0), 4)::DOUBLE AS importance, round(avg(epoch(TIMESTAMP '2024-02-01' - created_at) / 3600), 4)::DOUBLE AS age_h, round(avg(id % 20), 4)::DOUBLE AS accesses, least(count(*) / 100.0, 1.0)::DOUBLE AS size, 0.0::DOUBLE AS reserved_a,
round(avg(tau_initial), 4)::DOUBLE AS tau, round(var_pop(tau_initial), 4)::DOUBLE AS tau_var, 0.0::DOUBLE AS reserved_b, round(avg(CASE source_type WHEN 'direct' THEN 1.0 WHEN 'tool' THEN 0.7 ELSE 0.5 END), 4)::DOUBLE AS confidence FROM {EPISODES_SQL} GROUP BY 1""")
def a13_community_features(spark, sf_dir):
    """Nine features a community: importance, age, accesses, size, a reserved 0, tau and its variance, a reserved 0, confidence."""
    from ..operators.governance import source_rank
    from .temporal import age

    i = F.col("id")
    return episodes(spark, sf_dir).groupBy(F.col("namespace").alias("community")).agg(
        F.round(F.avg(i % 10 / 10), 4).alias("importance"), F.round(F.avg(age() / 3600), 4).alias("age_h"), F.round(F.avg(i % 20), 4).alias("accesses"), F.least(F.count("*") / 100, F.lit(1.0)).alias("size"), F.lit(0.0).alias("reserved_a"),
        F.round(F.avg("tau_initial"), 4).alias("tau"), F.round(F.var_pop("tau_initial"), 4).alias("tau_var"), F.lit(0.0).alias("reserved_b"), F.round(F.avg(source_rank(F.col("source_type"))), 4).alias("confidence"),
    )


@query(f"SELECT namespace, (max({{'n': n, 's': source_type}})).s AS majority FROM (SELECT namespace, source_type, count(*) AS n FROM {EPISODES_SQL} GROUP BY ALL) GROUP BY namespace")
def a14_majority_source(spark, sf_dir):
    g = episodes(spark, sf_dir).groupBy("namespace", "source_type").agg(F.count("*").alias("n"))
    return g.groupBy("namespace").agg(F.max(F.struct("n", "source_type")).alias("b")).select("namespace", F.col("b.source_type").alias("majority"))


@query("SELECT p_type AS concept, count(DISTINCT p_brand) AS communities, CASE WHEN count(DISTINCT p_brand) >= 3 THEN 'theory' ELSE 'hypothesis' END AS level, 0.5::DOUBLE AS confidence FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2")
def a15_shared_concepts(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("concept")).agg(F.countDistinct("p_brand").alias("communities")).where("communities >= 2")
    return g.select("concept", "communities", F.when(F.col("communities") >= 3, "theory").otherwise("hypothesis").alias("level"), F.lit(0.5).alias("confidence"))


@query(f"""WITH m AS {MEMBERS_SQL}, u AS (SELECT a.episode_id AS x, b.episode_id AS y FROM m a JOIN m b ON a.hyperedge_id = b.hyperedge_id AND a.episode_id <> b.episode_id GROUP BY ALL),
one AS (SELECT x AS seed, y AS id FROM u WHERE x % 100 = 0), two AS (SELECT DISTINCT o.seed, u.y AS id FROM one o JOIN u ON u.x = o.id)
SELECT seed, count(DISTINCT id) AS reached FROM (SELECT * FROM one UNION SELECT * FROM two) WHERE seed <> id GROUP BY seed""")
def j16_scope_reach(spark, sf_dir):
    """How many nodes two hops of shared hyperedges reach; the hops go through the hyperedges, so no pair of members is listed."""
    m = members(spark, sf_dir).select(F.col("hyperedge_id").alias("h"), F.col("episode_id").alias("id"))
    at = m.where("id % 100 = 0").select(F.col("id").alias("seed"), "id").distinct()
    reached = at
    for _ in range(2):
        at = at.join(m, "id").select("seed", "h").distinct().join(m, "h").select("seed", "id").distinct()
        reached = reached.union(at)
    return reached.where("seed != id").distinct().groupBy("seed").agg(F.count("*").alias("reached"))


@query(f"""WITH m AS {MEMBERS_SQL}, u AS (SELECT a.episode_id AS x, b.episode_id AS y FROM m a JOIN m b ON a.hyperedge_id = b.hyperedge_id GROUP BY ALL),
r AS (SELECT DISTINCT a.x AS query_id, b.y AS id FROM u a JOIN u b ON a.y = b.x WHERE a.x % 100 = 0)
SELECT k.query_id, k.id, k.score FROM {KNN_SQL} k JOIN r ON r.query_id = k.query_id AND r.id = k.id WHERE k.id <> k.query_id QUALIFY row_number() OVER (PARTITION BY k.query_id ORDER BY score DESC, k.id) <= 10""")
def v21_scope_recall(spark, sf_dir):
    """Neighbours by vector among the nodes within two hops: reach first, score what is left."""
    from ..operators.ranking import top_k
    from ..operators.retrieval import dot

    q, rows = vectors(spark, sf_dir)
    m = members(spark, sf_dir).select(F.col("hyperedge_id").alias("h"), F.col("episode_id").alias("id"))
    at = q.select("query_id", F.col("query_id").alias("id"))
    for _ in range(2):
        at = at.join(m, "id").select("query_id", "h").distinct().join(m, "h").select("query_id", "id").distinct()
    pairs = at.where("id != query_id").join(rows, "id").join(q.withColumnRenamed("vector", "asked"), "query_id")
    cos = dot(F.col("asked"), F.col("vector")) / F.sqrt(dot(F.col("asked"), F.col("asked")) * dot(F.col("vector"), F.col("vector")))
    return top_k(pairs.select("query_id", "id", F.round(cos, 6).alias("score")), ["query_id"], "score", "id", 10).select("query_id", "id", "score")


@query(f"SELECT query_id, CASE WHEN score >= 0.85 THEN id ELSE query_id END AS name FROM (SELECT * FROM {KNN_SQL} WHERE id % 100 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1)")
def f12_semantic_normalise(spark, sf_dir):
    """Each entity asked for takes the name of its nearest dictionary entry from cosine 0.85 on; the dictionary is all other rows."""
    from ..operators.vectors import nearest

    asked, rows = vectors(spark, sf_dir)
    found = nearest(asked, rows.where("id % 100 != 0"), k=1)
    return found.select("query_id", F.when(F.col("score") >= 0.85, F.col("id")).otherwise(F.col("query_id")).alias("name"))


REPORT_SQL = f"""WITH RECURSIVE g AS MATERIALIZED (SELECT id, content, source, tau_initial * exp(-(age / 1000) / win) AS tau, protected, age, id % 6 AS degree FROM {TAU_SQL} WHERE NOT quarantine),
e AS MATERIALIZED (SELECT src, dst FROM {EDGES_SQL} WHERE src IN (SELECT id FROM g) AND dst IN (SELECT id FROM g)), u AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r(id, low) AS (SELECT DISTINCT src, src FROM u UNION SELECT u.dst, r.low FROM r JOIN u ON u.src = r.id AND r.low < u.dst), m AS MATERIALIZED (SELECT id, min(low) AS community FROM r GROUP BY id),
c AS (SELECT community, count(*) AS size, least(3, count(DISTINCT source)) AS topics, least(20, count(*)) AS episodes, 'Community ' || community || ': ' || count(*) || ' members. ' || array_to_string((list(left(content, 100) ORDER BY id))[1:5], '; ') AS report FROM m JOIN g USING (id) GROUP BY community HAVING count(*) >= 2),
x AS MATERIALIZED (SELECT *, tau < 0.1 AND NOT (protected OR age < 7200 OR tau > 0.3 OR degree > 1) AS faded FROM g), gone AS (SELECT id FROM x WHERE faded AND (SELECT avg(faded::INT) FROM x) <= 0.5),
d AS (SELECT community, lower(trim(content)) AS t, count(*) AS n FROM m JOIN g USING (id) WHERE id NOT IN (SELECT id FROM gone) AND content IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
SELECT count(*) AS communities, sum(size)::BIGINT AS members, sum(topics)::BIGINT AS topics, sum(episodes)::BIGINT AS episodes, sum(least(20, len(list_distinct(regexp_extract_all(lower(report), '([a-z]{{4,}})', 1)))))::BIGINT AS keywords, (SELECT count(*) FROM gone) AS pruned,
 (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM d) AS conflicts, (SELECT count(*) FROM d) AS updated, (SELECT count(*) FROM g) AS size_before, (SELECT count(*) FROM g) - (SELECT count(*) FROM gone) - (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM d) AS size_after FROM c"""


@query(REPORT_SQL)
def g25_consolidation_run(spark, sf_dir):
    """All eight stages, with connected components as communities, which SQL can say; the report's counts. Stages lie in the run's folder and a run that was cut off goes on where it stopped."""
    e = episodes(spark, sf_dir).select("id", "content")
    nodes = _decayed(spark, sf_dir).join(e, "id").select("id", "content", "source", "tau", "protected", "age", (F.col("id") % 6).alias("degree"), "quarantine")
    parts = lambda edges: G.connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("community"))
    report, _ = consolidate(nodes, knn_graph(spark, sf_dir), Workspace(spark, "consolidation").path("run"), parts)
    return report.drop("at", "previous", "hash")


@query("SELECT 1 AS run_id, p_brand, count(*) AS size FROM part GROUP BY p_brand")
def m14_candidates(spark, sf_dir):
    """A consolidation run as JSON for review, one folder per run, read back."""
    ws = Workspace(spark, "candidates")
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("size")).withColumn("run_id", F.lit(1))
    p.write.mode("overwrite").partitionBy("run_id").json(ws.path("json"))
    return spark.read.schema("p_brand string, size long, run_id int").json(ws.path("json")).select("run_id", "p_brand", "size")


@query("""SELECT (SELECT count(*) FROM part WHERE p_partkey % 50 <> 7) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS edges, (SELECT count(*) FROM part WHERE p_partkey % 50 = 7) = 0 AS equal,
 (SELECT count(*) FROM part WHERE p_partkey % 50 = 7) AS lost""")
def m18_migration(spark, sf_dir):
    """Nodes and edges are copied to another format and verified by counts and by rows that only one side has; the copy of the nodes lost some."""
    ws = Workspace(spark, "migration")
    nodes, edges = table(spark, sf_dir, "part"), members(spark, sf_dir)
    nodes.where("p_partkey % 50 <> 7").write.orc(ws.path("nodes"))
    edges.write.orc(ws.path("edges"))
    copied, linked = spark.read.orc(ws.path("nodes")), spark.read.orc(ws.path("edges"))
    differs = nodes.exceptAll(copied).union(copied.exceptAll(nodes)).select(F.lit("differs").alias("kind"))
    differs = differs.union(edges.exceptAll(linked).union(linked.exceptAll(edges)).select(F.lit("differs")))
    every = copied.select(F.lit("node").alias("kind")).union(linked.select(F.lit("edge"))).union(differs)
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return every.agg(n("node").alias("nodes"), n("edge").alias("edges"), (n("differs") == 0).alias("equal"), n("differs").alias("lost"))
