"""Lookups, writes, filters, joins, aggregates, top-k and set operations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import mutations as M
from ..operators import ranking as R
from ..operators.temporal import keep_last
from ..shared import Workspace, within
from ..sources.files import alias_files, benchmark_instances, export_skills, media_files, rule_files, save_media, skill_files
from ..sources.tables import EPISODES_SQL, MEMBERS_SQL, episodes, members, table
from .catalog import query

# --- lookups and scans


@query(f"SELECT id, source, version FROM {EPISODES_SQL} WHERE id = 42")
def s1_point_lookup(spark, sf_dir):
    return episodes(spark, sf_dir).where("id = 42").select("id", "source", "version")


@query(f"SELECT id, source FROM {EPISODES_SQL} WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)")
def s2_batch_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("id"))
    return episodes(spark, sf_dir).select("id", "source").join(wanted, "id", "left_semi")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 30 MINUTE AND ts < TIMESTAMP '2024-01-30'")
def s3_recent_scan(spark, sf_dir):
    end = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where((F.col("ts") >= end - F.expr("interval 30 minutes")) & (F.col("ts") < end)).select("event_id", "user_id")


@query(f"SELECT id, tau_initial FROM {EPISODES_SQL} WHERE tau_initial BETWEEN 0.2 AND 0.4 ORDER BY id LIMIT 50")
def s4_tau_range(spark, sf_dir):
    return episodes(spark, sf_dir).where(F.col("tau_initial").between(0.2, 0.4)).select("id", "tau_initial").orderBy("id").limit(50)


@query("SELECT c.c_custkey, n.n_name FROM (SELECT *, lower(n_name) AS p FROM nation WHERE n_nationkey % 4 = 1) n JOIN customer c ON lower(c_name) = p OR starts_with(p || ' ' || lower(c_name), p || ' ') AND c.c_nationkey = n.n_nationkey")
def s6_prefix_scan(spark, sf_dir):
    """Names equal to a candidate or beginning with it and a space: a true prefix, joined by the first word."""
    n = table(spark, sf_dir, "nation").where("n_nationkey % 4 = 1").select("n_name", F.lower("n_name").alias("p"), F.split(F.lower("n_name"), " ")[0].alias("word"), "n_nationkey")
    full = F.concat_ws(" ", F.lower("n_name"), F.lower("c_name"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select("c_custkey", full.alias("name"), F.split(full, " ")[0].alias("word"))
    return c.join(n, "word").where((F.col("name") == F.col("p")) | F.col("name").startswith(F.concat("p", F.lit(" ")))).select("c_custkey", "n_name")


@query(f"SELECT hyperedge_id AS src, episode_id AS dst, count(*) OVER (PARTITION BY hyperedge_id) AS degree FROM {MEMBERS_SQL}")
def s8_adjacency(spark, sf_dir):
    """Every edge with the degree of its source; an aggregate joins back, so no node's edges meet in a row."""
    m = members(spark, sf_dir).toDF("src", "dst")
    return m.join(m.groupBy("src").agg(F.count("*").alias("degree")), "src").select("src", "dst", "degree")


@query("SELECT p_type, support FROM (SELECT p_type, max(p_brand) AS brand, count(*) AS support FROM part GROUP BY p_type) WHERE contains(lower(p_type), 'large') OR contains(lower(brand), 'brand#5') ORDER BY support DESC, p_type LIMIT 5")
def s9_keyword_scan(spark, sf_dir):
    """Schema rows that hold one of the terms in either column, the best supported first."""
    schemas = table(spark, sf_dir, "part").groupBy("p_type").agg(F.max("p_brand").alias("brand"), F.count("*").alias("support"))
    hit = F.lower("p_type").contains("large") | F.lower("brand").contains("brand#5")
    return schemas.where(hit).select("p_type", "support").orderBy(F.desc("support"), "p_type").limit(5)


@query("SELECT question_id, question, turns, first_date::VARCHAR AS first_date, last_date::VARCHAR AS last_date FROM (SELECT conv_id AS question_id, min(text) FILTER (turn = 0 OR role = 'user') AS question, count(*) AS turns, min(DATE '2024-01-01' + (conv_id % 300)::INT) AS first_date, max(DATE '2024-01-01' + (conv_id % 300)::INT) AS last_date FROM conversations GROUP BY 1)")
def s13_benchmark_json(spark, sf_dir):
    """A benchmark file is an array of instances: question, sessions of turns, dates as text. One is written from the conversations, then read."""
    c = table(spark, sf_dir, "conversations")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 300).cast("int"))
    asked = F.min(F.when((F.col("turn") == 0) | (F.col("role") == "user"), F.col("text")))
    made = c.groupBy("conv_id").agg(asked.alias("question"), F.array(turns).alias("haystack_sessions")).select(F.col("conv_id").alias("question_id"), "question", "haystack_sessions", F.array(F.date_format(day, "yyyy/MM/dd (EEE) HH:mm")).alias("haystack_dates"))
    path = Workspace(spark, "instances").path("instances")
    made.write.mode("overwrite").json(path)
    got = benchmark_instances(spark, path)
    return got.select("question_id", "question", F.aggregate("haystack_sessions", F.lit(0).cast("long"), lambda n, s: n + F.size(s)).alias("turns"), F.to_date(F.array_min("dates")).cast("string").alias("first_date"), F.to_date(F.array_max("dates")).cast("string").alias("last_date"))


@query("SELECT name, kind, size::BIGINT AS size FROM (SELECT n_name || '.png' AS name, 'image' AS kind, 8 + n_nationkey AS size FROM nation UNION ALL SELECT r_name || '.wav', 'audio', 16 FROM region)")
def s14_media_files(spark, sf_dir):
    """Media under a base folder, by kind; the files are written first."""
    png = table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".png")).alias("name"), F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.rpad(F.lit("").cast("binary"), F.col("n_nationkey"), F.unhex(F.lit("00")))).alias("content"))
    wav = table(spark, sf_dir, "region").select(F.concat("r_name", F.lit(".wav")).alias("name"), F.rpad(F.lit("").cast("binary"), F.lit(16), F.unhex(F.lit("01"))).alias("content"))
    folder = Workspace(spark, "media").path("media")
    save_media(png.union(wav), folder)
    return media_files(spark, folder).select("name", "kind", "size")


@query("SELECT alias, entity FROM (SELECT lower(n_name) AS alias, n_name AS entity FROM nation)")
def s15_rule_files(spark, sf_dir):
    """Alias files are JSON maps; a missing or broken one is an empty table."""
    ws = Workspace(spark, "rules")
    table(spark, sf_dir, "nation").select(F.create_map(F.lower("n_name"), "n_name").alias("aliases")).write.mode("overwrite").json(ws.path("good"))
    table(spark, sf_dir, "region").select(F.concat(F.lit("{broken "), "r_name").alias("value")).write.mode("overwrite").text(ws.path("broken"))
    return alias_files(spark, ws.path("good")).union(alias_files(spark, ws.path("broken"))).union(alias_files(spark, ws.path("missing")))


@query("SELECT n_name AS name, r_name AS parent, array_to_string([lower(n_name), lower(left(n_name, 3))], ',') AS keys FROM nation JOIN region ON n_regionkey = r_regionkey")
def s15_ontology_rules(spark, sf_dir):
    """Files of type rules: a JSON object of types with parent and keys, over a whole file or a line; missing, broken and other JSON is an empty table."""
    ws = Workspace(spark, "rules")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rule = F.struct(F.col("r_name").alias("parent"), F.array(F.lower("n_name"), F.lower(F.substring("n_name", 1, 3))).alias("keys"))
    n.select(F.create_map("n_name", rule).alias("types")).write.json(ws.path("good"))
    table(spark, sf_dir, "region").select(F.concat(F.lit("{broken "), "r_name").alias("value")).write.text(ws.path("broken"))
    table(spark, sf_dir, "region").select(F.lit("[1, 2]").alias("value")).write.text(ws.path("list"))
    found = [rule_files(spark, ws.path(f)) for f in ("good", "broken", "list", "missing")]
    return reduce(DataFrame.union, found).select("name", "parent", F.array_join("keys", ",").alias("keys"))


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 10")
def s10_visual_scan(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label").orderBy("vec_id").limit(10)


WRITE_WORDS = re.compile(r"\b(create|insert|set|delete|detach|remove|merge|drop|alter)\b", re.I)


def read_only(spark, text: str, args: dict, **views):
    """Runs a query with named parameters; refuses text that writes, not counting quoted literals."""
    if WRITE_WORDS.search(re.sub(r"'(?:[^']|'')*'", "''", text)):
        raise ValueError("only reading queries are allowed")
    return spark.sql(text, args=args, **views)


@query("SELECT source, count(*) AS n FROM documents WHERE n_chars > 1000 GROUP BY source")
def s11_ad_hoc_query(spark, sf_dir):
    return read_only(spark, "SELECT source, count(*) AS n FROM {docs} WHERE n_chars > :least GROUP BY source", {"least": 1000}, docs=table(spark, sf_dir, "documents"))


@query(f"SELECT id, created_at FROM {EPISODES_SQL} ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def s12_paging(spark, sf_dir):
    return episodes(spark, sf_dir).select("id", "created_at").orderBy(F.desc("created_at"), "id").offset(40).limit(20)


# --- writes


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 3 = 0)
UNION ALL SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_extendedprice DESC) = 1""")
def m1_upsert(spark, sf_dir):
    cur = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(0).alias("seq"))
    inc = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2 AND l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"), F.col("l_linenumber").alias("seq"))
    return M.upsert(cur, inc, "o_orderkey", ["seq", "o_totalprice"]).drop("seq")


@query("SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE (l_orderkey, l_partkey) NOT IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1)")
def m2_insert_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    return M.insert_edges(li.where("l_linenumber = 1"), li.drop("l_linenumber"), ["src", "dst"])


@query("""SELECT o_orderkey AS id, CASE WHEN hit THEN new ELSE o_orderpriority END AS state, version + (CASE WHEN hit AND expected IS NOT NULL THEN 1 ELSE 0 END)::INT AS version, coalesce(new IS NOT NULL AND NOT hit, false) AS conflict
FROM (SELECT *, new IS NOT NULL AND (expected IS NULL OR expected = version) AS hit FROM
 (SELECT o_orderkey, o_orderpriority, (o_orderkey % 3)::INT AS version, CASE WHEN o_orderkey % 2 = 0 THEN 'patched' END AS new, CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 2 = 0 THEN (o_orderkey % 4)::INT END AS expected FROM orders))""")
def m3_compare_and_set(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    cur = o.select(k.alias("id"), F.col("o_orderpriority").alias("state"), (k % 3).cast("int").alias("version"))
    upd = o.where(k % 2 == 0).select(k.alias("id"), F.lit("patched").alias("new"), F.when(k % 10 != 0, (k % 4).cast("int")).alias("expected"))
    return M.compare_and_set(cur, upd, "id", "state").select("id", "state", "version", "conflict")


LINEAGE_SQL = "(SELECT doc_id AS id, min(doc_id) OVER (ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS repl FROM (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1))"


@query(f"SELECT 'node' AS kind, id, CASE WHEN archived OR id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END AS value FROM {EPISODES_SQL} UNION ALL SELECT 'SUPERSEDES', repl, l.id FROM {LINEAGE_SQL} l JOIN documents ON doc_id = l.id WHERE repl IS NOT NULL")
def m4_archive(spark, sf_dir):
    """Nodes with their flag, and an edge from each replacement to what it replaces; the next flagged document replaces one."""
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    step = M.next_of(bad, "id")
    return M.archive_with_lineage(episodes(spark, sf_dir).select("id", "archived"), step, "id")


@query(f"SELECT id, archived AND id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AS archived FROM {EPISODES_SQL}")
def m5_unarchive(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return M.archive(episodes(spark, sf_dir).select("id", "archived"), good, "id", False)


@query("""WITH gone AS (SELECT DISTINCT conv_id FROM conversations WHERE turn = 3)
SELECT 'member' AS kind, conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM gone) UNION ALL SELECT DISTINCT 'session', conv_id, -1 FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM gone)
UNION ALL SELECT 'deleted', conv_id, count(*) FROM conversations WHERE conv_id IN (SELECT conv_id FROM gone) GROUP BY conv_id""")
def m6_cascade_delete(spark, sf_dir):
    """Sessions that reached a third turn go with their members: what is left of both, and how many members each lost session had."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    gone = c.where("turn = 3").select("conv_id").distinct()
    left = M.delete(c, gone, "conv_id").select(F.lit("member").alias("kind"), "conv_id", "turn")
    sessions = M.delete(c.select("conv_id").distinct(), gone, "conv_id").select(F.lit("session"), "conv_id", F.lit(-1).cast("long"))
    counts = c.join(gone, "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("n")).select(F.lit("deleted"), "conv_id", "n")
    return left.union(sessions).union(counts)


@query("""SELECT coalesce(a.vec_id, b.id) AS id, CASE WHEN b.id IS NOT NULL THEN 'written' ELSE 'kept' END AS state, round(coalesce(b.v, a.embedding)[1]::DOUBLE, 3)::DOUBLE AS first, len(coalesce(b.v, a.embedding)) AS dims FROM embeddings a
FULL JOIN (SELECT vec_id + 40 AS id, embedding AS v FROM embeddings WHERE vec_id % 3 = 0 AND embedding IS NOT NULL) b ON b.id = a.vec_id""")
def m7_upsert_vectors(spark, sf_dir):
    """A batch of vectors is merged with the stored ones: new ids are added, known ones replaced, the rest kept; rows without a vector write nothing."""
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    batch = stored.where("id % 3 = 0").select((F.col("id") + 40).alias("id"), "vector")
    merged = M.upsert_vectors(stored, batch)
    return merged.select("id", "state", F.round(F.col("vector")[0].cast("double"), 3).alias("first"), F.size("vector").cast("long").alias("dims"))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def m8_index_removal(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id"))
    return M.delete(table(spark, sf_dir, "embeddings").select("vec_id"), gone, "vec_id")


@query("""WITH r AS (SELECT trim(p_brand) AS s, trim(CASE WHEN p_size % 9 = 0 THEN ' ' ELSE p_type END) AS o FROM part), v AS (SELECT * FROM r WHERE s <> '' AND o <> '')
SELECT 'edge' AS kind, s AS a, o AS b, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT 'node', x, '', 0 FROM (SELECT s AS x FROM v UNION SELECT o FROM v) UNION ALL SELECT 'errors', '', '', (SELECT count(*) FROM r) - (SELECT count(*) FROM v)""")
def m10_bulk_relations(spark, sf_dir):
    """Triples without blank ends become nodes and typed edges, each once; the rest is counted."""
    r = table(spark, sf_dir, "part").select(F.trim("p_brand").alias("s"), F.trim(F.when(F.col("p_size") % 9 == 0, " ").otherwise(F.col("p_type"))).alias("o"))
    good = (F.col("s") != "") & (F.col("o") != "")
    v = r.where(good)
    edges = v.groupBy("s", "o").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("s").alias("a"), F.col("o").alias("b"), "n")
    none = F.lit("")
    nodes = v.select("s").union(v.select("o")).distinct().select(F.lit("node"), "s", none, F.lit(0).cast("long"))
    errors = r.agg((F.count("*") - F.count_if(good)).alias("n")).select(F.lit("errors"), none, none, "n")
    return edges.union(nodes).union(errors)


@query("SELECT doc_id AS id, 'direct' AS source_type, 'active' AS fact_track, 1 AS version, false AS archived FROM documents WHERE length(trim(text)) > 0")
def m11_batch_load(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.length(F.trim("text")) > 0)
    return d.select(F.col("doc_id").alias("id"), F.lit("direct").alias("source_type"), F.lit("active").alias("fact_track"), F.lit(1).alias("version"), F.lit(False).alias("archived"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def m12_orphan_hyperedges(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return M.orphans(table(spark, sf_dir, "orders").select("o_orderkey"), m, "o_orderkey")


@query(f"""SELECT 'edge' AS kind, hyperedge_id, episode_id FROM {MEMBERS_SQL} WHERE hyperedge_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'node', o_orderkey, -1 FROM orders WHERE o_orderstatus <> 'F' OR o_orderstatus IS NULL""")
def m13_detach_delete(spark, sf_dir):
    """The hyperedge and its edges go together: what is left of both."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hyperedge_id"), "o_orderstatus")
    gone = o.where("o_orderstatus = 'F'").select("hyperedge_id")
    edges = M.delete(members(spark, sf_dir), gone, "hyperedge_id").select(F.lit("edge").alias("kind"), "hyperedge_id", "episode_id")
    return edges.union(M.delete(o.select("hyperedge_id"), gone, "hyperedge_id").select(F.lit("node"), "hyperedge_id", F.lit(-1).cast("long")))


@query("""WITH c AS (SELECT o_custkey AS queue, o_orderkey AS run_id, o_orderdate AS created, o_orderstatus = 'F' AS applied, count(l_partkey) AS members, coalesce(sum(length(p_name)), 0) AS report, count(*) FILTER (l_returnflag = 'R') AS conflicts
 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL),
q AS (SELECT *, count(*) OVER (PARTITION BY queue) AS files, row_number() OVER (PARTITION BY queue, applied ORDER BY created, run_id) AS place FROM c)
SELECT queue, run_id, CASE WHEN members > 0 AND report > 30 AND conflicts = 0 THEN 'applied' ELSE 'discarded' END AS decision FROM q WHERE files >= 20 AND NOT applied AND place = 1""")
def m15_auto_apply(spark, sf_dir):
    """Of each queue with twenty candidate files or more the oldest pending one is looked at, one a round: applied if it has members, a report of over 30 characters and no conflict, else discarded."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", F.length("p_name").alias("t")), F.col("p_partkey") == F.col("l_partkey"), "left")
    made = li.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("l_partkey").alias("members"), F.coalesce(F.sum("t"), F.lit(0)).alias("report"), F.count_if(F.col("l_returnflag") == "R").alias("conflicts"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("queue"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created"), (F.col("o_orderstatus") == "F").alias("applied"))
    full = runs.groupBy("queue").agg(F.count("*").alias("files")).where("files >= 20")
    oldest = runs.where("NOT applied").groupBy("queue").agg(F.min(F.struct("created", "run_id")).alias("o")).select("queue", "o.run_id")
    ok = (F.coalesce("members", F.lit(0)) > 0) & (F.col("report") > 30) & (F.col("conflicts") == 0)
    return oldest.join(full, "queue", "left_semi").join(made, "run_id", "left").select("queue", "run_id", F.when(ok, "applied").otherwise("discarded").alias("decision"))


@query("SELECT p_brand AS name, '# ' || p_brand || chr(10) || string_agg(DISTINCT p_type, chr(10) ORDER BY p_type) AS body FROM part GROUP BY p_brand ORDER BY name LIMIT 6")
def m16_skill_export(spark, sf_dir):
    """Skills are files in a folder of their own, three a round at most, and one that is there stays as it is; two rounds, and the second one's bodies of known skills differ."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    skills = p.groupBy(F.col("p_brand").alias("name")).agg(F.concat(F.lit("# "), "p_brand", F.lit("\n"), F.concat_ws("\n", F.sort_array(F.collect_list("p_type")))).alias("body"))
    ws = Workspace(spark, "skills")
    folder = ws.path("skills")
    export_skills(skills, folder)
    export_skills(skills.join(skill_files(spark, folder).select("name").withColumn("there", F.lit("old ")), "name", "left").select("name", F.concat(F.coalesce("there", F.lit("")), "body").alias("body")), folder)
    return skill_files(spark, folder)


@query("SELECT ':' || r_name || ' a owl:Class .' AS line FROM region UNION ALL SELECT ':' || n_name || ' a owl:Class ; rdfs:subClassOf :' || r_name || ' .' FROM nation JOIN region ON n_regionkey = r_regionkey")
def m17_turtle_export(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = r.select(F.concat(F.lit(":"), "r_name", F.lit(" a owl:Class .")).alias("line"))
    return top.union(n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit(":"), "n_name", F.lit(" a owl:Class ; rdfs:subClassOf :"), "r_name", F.lit(" ."))))


@query("SELECT 'orders' AS label, (SELECT count(*) FROM orders) AS n_source, (SELECT count(*) FROM orders WHERE o_orderkey % 50 <> 7) AS n_copy, (SELECT 2 * count(*) FILTER (o_orderkey % 50 = 8) + count(*) FILTER (o_orderkey % 50 = 7) FROM orders) AS differing")
def f38_copy_verification(spark, sf_dir):
    """A copy is verified by counts and by rows that only one side has, both ways; this one lost some rows and changed others."""
    a = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    b = Workspace(spark, "copy").save(a.where(k % 50 != 7).withColumn("o_totalprice", F.when(k % 50 == 8, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))), "orders")
    sides = a.select(F.lit(1).alias("side"), "*").union(b.select(F.lit(2), "*"))
    rows = sides.groupBy(*a.columns).agg(F.count_if(F.col("side") == 1).alias("x"), F.count_if(F.col("side") == 2).alias("y"))
    return rows.agg(F.lit("orders").alias("label"), F.sum("x").alias("n_source"), F.sum("y").alias("n_copy"), F.sum(F.abs(F.col("x") - F.col("y"))).alias("differing"))


# --- filters and projections


@query("SELECT r_regionkey, r_name, n.n_nationkey, n.n_name, n.n_regionkey FROM region JOIN nation n ON n_regionkey = r_regionkey")
def p1_star_projection(spark, sf_dir):
    """All properties of both nodes, whatever they are called."""
    r, n = table(spark, sf_dir, "region").alias("r"), table(spark, sf_dir, "nation").alias("n")
    return r.join(n, F.col("n.n_regionkey") == F.col("r.r_regionkey")).select("r.*", "n.*")


@query("SELECT a.l_orderkey, a.l_partkey AS seed, b.l_partkey AS other FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 100 = 0) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey")
def p10_unequal_pairs(spark, sf_dir):
    m = members(spark, sf_dir).toDF("l_orderkey", "other")
    seeds = m.where("other % 100 = 0").withColumnRenamed("other", "seed")
    return seeds.join(m, "l_orderkey").where("seed != other").select("l_orderkey", "seed", "other")


@query(f"SELECT id, source, namespace FROM {EPISODES_SQL} WHERE NOT coalesce(archived, false) AND NOT quarantine")
def p2_visible_episodes(spark, sf_dir):
    return episodes(spark, sf_dir).where(~F.coalesce("archived", F.lit(False)) & ~F.col("quarantine")).select("id", "source", "namespace")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def p3_quarantine_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_anti")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def p4_namespace_filter(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn").join(c.where("role = 'system'").select("conv_id"), "conv_id", "left_semi")


@query("""SELECT o_orderkey, o_totalprice FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN ['global'] WHEN 1 THEN ['a1'] WHEN 2 THEN ['a1', 'a2'] ELSE ['a3'] END AS scope FROM orders)
WHERE list_contains(scope, 'a2') OR list_contains(scope, 'global') ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def p5_visible_hyperedges(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    s = lambda *v: F.array(*map(F.lit, v))
    scope = F.when(k == 0, s("global")).when(k == 1, s("a1")).when(k == 2, s("a1", "a2")).otherwise(s("a3"))
    o = table(spark, sf_dir, "orders").where(F.array_contains(scope, "a2") | F.array_contains(scope, "global"))
    return o.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT doc_id, 0.5::DOUBLE AS score FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'scum') OR contains(lower(text), 'trash') ORDER BY doc_id LIMIT 20")
def p6_text_fallback(spark, sf_dir):
    hit = F.exists(F.array(*map(F.lit, ("idiot", "scum", "trash"))), lambda t: (F.length(t) > 0) & F.lower("text").contains(t))
    return table(spark, sf_dir, "documents").where(hit).select("doc_id", F.lit(0.5).alias("score")).orderBy("doc_id").limit(20)


@query("SELECT p_partkey FROM part WHERE p_type LIKE 'PROMO%' OR starts_with(lower(p_name), 'a')")
def p7_prefix_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_type").startswith("PROMO") | F.lower("p_name").startswith("a")).select("p_partkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 3, 5, 99)")
def p8_in_list(spark, sf_dir):
    return table(spark, sf_dir, "nation").where(F.col("n_nationkey").isin(1, 3, 5, 99)).select("n_nationkey", "n_name")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL")
def p9_null_test(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").where("toxic IS NULL").select("doc_id")


@query("SELECT r_regionkey, 1 AS test, 'x' AS letter, 2.5::DOUBLE AS number FROM region")
def p11_constant(spark, sf_dir):
    """Constants beside the rows of a table."""
    return spark.sql("SELECT r_regionkey, 1 AS test, 'x' AS letter, 2.5D AS number FROM {r}", r=table(spark, sf_dir, "region"))


@query("SELECT doc_id FROM documents WHERE source = 'src1' AND n_chars >= 100")
def p12_bound_parameters(spark, sf_dir):
    return spark.sql("SELECT doc_id FROM {d} WHERE source = :s AND n_chars >= :n", args={"s": "src1", "n": 100}, d=table(spark, sf_dir, "documents"))


# --- joins


@query(f"SELECT m.hyperedge_id, p_brand, count(*) AS n FROM {MEMBERS_SQL} m JOIN part ON p_partkey = episode_id GROUP BY ALL")
def j1_members_join(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("episode_id"), "p_brand")
    return members(spark, sf_dir).join(p, "episode_id").groupBy("hyperedge_id", "p_brand").agg(F.count("*").alias("n"))


COMEMBERS_SQL = f"""(SELECT a.episode_id AS seed, b.episode_id AS id, count(*) AS n FROM {MEMBERS_SQL} a JOIN {MEMBERS_SQL} b ON a.hyperedge_id = b.hyperedge_id AND a.episode_id <> b.episode_id
WHERE a.episode_id % 100 = 0 GROUP BY ALL)"""


def co_members(spark, sf_dir):
    m = members(spark, sf_dir)
    seeds = m.where("episode_id % 100 = 0").select("hyperedge_id", F.col("episode_id").alias("seed"))
    return seeds.join(m.withColumnRenamed("episode_id", "id"), "hyperedge_id").where("seed != id").groupBy("seed", "id").agg(F.count("*").alias("n"))


@query(f"SELECT seed, id, n FROM {COMEMBERS_SQL} QUALIFY row_number() OVER (PARTITION BY seed ORDER BY n DESC, id) <= 10")
def j2_cooccurrence_neighbours(spark, sf_dir):
    return keep_last(co_members(spark, sf_dir), ["seed"], [F.desc("n"), F.col("id")], 10)


@query("""WITH e AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM supplier JOIN customer ON c_custkey % 1500 = s_suppkey),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), two AS (SELECT DISTINCT x.a, y.b FROM u x JOIN u y ON x.b = y.a), three AS (SELECT DISTINCT x.a, y.b FROM two x JOIN u y ON x.b = y.a),
r AS (SELECT * FROM u UNION SELECT * FROM two UNION SELECT * FROM three)
SELECT a, count(*) AS reached, round(0.6 + 0.4 * count(*) / 25.0, 6)::DOUBLE AS score FROM r WHERE a <> b GROUP BY a""")
def j3_paths_up_to_three(spark, sf_dir):
    """Pairs joined by an undirected path of 1 to 3 edges: unrolled joins, distinct after each hop."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    e = s.join(c, F.col("c_custkey") % 1500 == F.col("s_suppkey")).select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).distinct()
    u = e.union(e.select("b", "a")).distinct()
    step = u.select(F.col("a").alias("b"), F.col("b").alias("c"))
    two = u.join(step, "b").select("a", F.col("c").alias("b")).distinct()
    three = two.join(step, "b").select("a", F.col("c").alias("b")).distinct()
    reached = u.union(two).union(three).distinct().where("a != b")
    return reached.groupBy("a").agg(F.count("*").alias("reached"), F.round(0.6 + 0.4 * F.count("*") / 25, 6).alias("score"))


@query("""SELECT o_orderkey, count(DISTINCT l_partkey) AS n, coalesce(array_to_string(list_sort(list(DISTINCT l_partkey) FILTER (l_partkey IS NOT NULL)), ','), '') AS ids
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def j4_left_collect(spark, sf_dir):
    m = members(spark, sf_dir).withColumnRenamed("hyperedge_id", "o_orderkey")
    j = table(spark, sf_dir, "orders").select("o_orderkey").join(m, "o_orderkey", "left")
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("episode_id")), lambda x: x.cast("string")))
    return j.groupBy("o_orderkey").agg(F.count("episode_id").alias("n"), ids.alias("ids"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def j5_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 150000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def j6_semi_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT a.r_name AS a, b.n_name AS b FROM region a, nation b WHERE a.r_regionkey = 1 AND b.n_nationkey IN (3, 4)")
def j7_bound_cross_match(spark, sf_dir):
    """Both sides are bound to single keys before they meet; a row of bindings joins them by a constant key."""
    a = table(spark, sf_dir, "region").where("r_regionkey = 1").select(F.lit(1).alias("k"), F.col("r_name").alias("a"))
    return a.join(table(spark, sf_dir, "nation").where("n_nationkey IN (3, 4)").select(F.lit(1).alias("k"), F.col("n_name").alias("b")), "k").drop("k")


@query(f"SELECT l_orderkey, l_linenumber, coalesce(e.fact_track, 'active') AS fact_track, coalesce(e.archived, false) AS archived FROM lineitem LEFT JOIN {EPISODES_SQL} e ON e.id = l_partkey")
def j8_enrichment(spark, sf_dir):
    e = episodes(spark, sf_dir).select(F.col("id").alias("l_partkey"), "fact_track", "archived")
    j = table(spark, sf_dir, "lineitem").join(e, "l_partkey", "left")
    return j.select("l_orderkey", "l_linenumber", F.coalesce("fact_track", F.lit("active")).alias("fact_track"), F.coalesce("archived", F.lit(False)).alias("archived"))


@query("""SELECT a.p_partkey AS id, b.p_partkey AS other FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_size <> b.p_size AND a.p_partkey <> b.p_partkey
QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) <= 5""")
def j10_contradictions(spark, sf_dir):
    """Five others of a key with another value. Of each value the five smallest ids are kept, and of a key the ten smallest of those: five of them at least have another value than any given row, so no key is paired off."""
    p = table(spark, sf_dir, "part").select("p_type", "p_brand", F.col("p_size").alias("v"), F.col("p_partkey").alias("id"))
    few = keep_last(p.where("v IS NOT NULL"), ["p_type", "p_brand", "v"], [F.col("id")], 5)
    few = keep_last(few, ["p_type", "p_brand"], [F.col("id")], 10).withColumnRenamed("v", "w").withColumnRenamed("id", "other")
    return keep_last(p.join(few, ["p_type", "p_brand"]).where("v != w AND id != other").select("id", "other"), ["id"], [F.col("other")], 5)


@query("""SELECT DISTINCT d.doc_id, e.entity FROM (SELECT doc_id, doc_id % 4 AS kind, unnest(regexp_split_to_array(lower(text), '[^a-z0-9à-ÿ]+')) AS word FROM documents) d
JOIN (SELECT item_id % 4 AS kind, regexp_split_to_array(lower(text), '[^a-z0-9à-ÿ]+')[2] AS entity FROM benchmark) e ON e.kind = d.kind AND e.entity = d.word WHERE e.entity <> ''""")
def j11_contradictory_claims(spark, sf_dir):
    """Claims of one type (the id modulo 4) whose text holds an entity (the second word of an item) as a word: both sides meet by type and word, not by scanning all texts for all entities."""
    split = F.split(F.lower("text"), r"[^a-z0-9à-ÿ]+")
    e = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 4).alias("kind"), F.try_element_at(split, F.lit(2)).alias("word")).where("word != ''").distinct()
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("kind"), F.explode(F.array_distinct(split)).alias("word"))
    return d.join(e, ["kind", "word"]).select("doc_id", F.col("word").alias("entity"))


@query("SELECT a.event_id, b.event_id AS near FROM events a JOIN events b ON b.user_id = a.user_id AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) - 300000000 AND epoch_us(a.ts) - 1")
def j13_window_self_match(spark, sf_dir):
    """Writes of one source in the 300 seconds before, a row a match: sources meet by stretches of 300 seconds, each in its own and the next one, so a source's history is never joined with itself."""
    span, stretch = 300_000_000, F.floor(F.col("at") / 300_000_000)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    before = e.withColumn("stretch", F.explode(F.array(stretch, stretch + 1))).select("user_id", "stretch", F.col("event_id").alias("near"), F.col("at").alias("then"))
    j = e.withColumn("stretch", stretch).join(before, ["user_id", "stretch"])
    return j.where((F.col("then") >= F.col("at") - span) & (F.col("then") < F.col("at"))).select("event_id", "near")


@query("""WITH p AS (SELECT c_custkey, s_suppkey, (c_custkey + s_suppkey) % 11 = 0 AS unknown, c_nationkey AS na, s_nationkey AS nb, c_mktsegment AS seg FROM customer JOIN supplier ON s_suppkey = c_custkey % 100)
SELECT c_custkey, s_suppkey, (CASE WHEN unknown OR a.n_nationkey IS NULL OR b.n_nationkey IS NULL THEN 1.0 WHEN na = nb AND c_custkey % 100 = s_suppkey AND c_custkey < 100 THEN 1.0 WHEN na = nb THEN 0.9 WHEN a.n_regionkey = b.n_regionkey THEN 0.7 WHEN a.n_regionkey % 2 = b.n_regionkey % 2 THEN 0.5 ELSE 0.3 END)::DOUBLE AS distance
FROM p LEFT JOIN nation a ON a.n_nationkey = na LEFT JOIN nation b ON b.n_nationkey = nb""")
def j14_ontological_distance(spark, sf_dir):
    """Entity, type, category, parent: one entity 1.0, one type (nation) 0.9, one category (region) 0.7, one parent 0.5, else 0.3; what the hierarchy doesn't know is no ground for doubt: 1.0."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("na"), (F.col("c_custkey") % 100).alias("s_suppkey"))
    j = c.join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nb")), "s_suppkey")
    unknown = (F.col("c_custkey") + F.col("s_suppkey")) % 11 == 0
    j = j.withColumn("ka", F.when(~unknown, F.col("na"))).join(n.toDF("ka", "ra"), "ka", "left").join(n.toDF("nb", "rb"), "nb", "left")
    same = (F.col("c_custkey") % 100 == F.col("s_suppkey")) & (F.col("c_custkey") < 100)
    d = F.when(F.col("ra").isNull() | F.col("rb").isNull(), 1.0).when((F.col("na") == F.col("nb")) & same, 1.0).when(F.col("na") == F.col("nb"), 0.9).when(F.col("ra") == F.col("rb"), 0.7).when(F.col("ra") % 2 == F.col("rb") % 2, 0.5).otherwise(0.3)
    return j.select("c_custkey", "s_suppkey", d.alias("distance"))


@query(f"""WITH m AS {MEMBERS_SQL}, s AS (SELECT DISTINCT hyperedge_id AS community FROM m WHERE episode_id % 100 = 0)
SELECT community, m.episode_id, tau_initial FROM s JOIN m ON m.hyperedge_id = community JOIN {EPISODES_SQL} e ON e.id = m.episode_id QUALIFY row_number() OVER (PARTITION BY community ORDER BY tau_initial DESC, m.episode_id) <= 10""")
def j15_seed_communities(spark, sf_dir):
    m = members(spark, sf_dir).withColumnRenamed("hyperedge_id", "community")
    e = episodes(spark, sf_dir).select(F.col("id").alias("episode_id"), "tau_initial")
    j = m.join(m.where("episode_id % 100 = 0").select("community").distinct(), "community").join(e, "episode_id")
    return keep_last(j, ["community"], [F.desc("tau_initial"), F.col("episode_id")], 10).select("community", "episode_id", "tau_initial")


# --- aggregates


@query(f"SELECT count(*) AS episodes, count(*) FILTER (archived) AS archived, count(*) FILTER (fact_track = 'core') AS core, count(DISTINCT source) AS sources FROM {EPISODES_SQL}")
def a1_overview(spark, sf_dir):
    return episodes(spark, sf_dir).agg(F.count("*").alias("episodes"), F.count_if("archived").alias("archived"), F.count_if(F.col("fact_track") == "core").alias("core"), F.countDistinct("source").alias("sources"))


NORM_SQL = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def normal_text(column="text"):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(column), r"[^a-z0-9\s]", " "), r"\s+", " "))


def _evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    g = d.groupBy(F.sha2(normal_text(), 256).alias("evidence")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first_id"))
    return g.withColumn("boost", F.round(F.least(F.lit(5.0), F.log2(F.col("n") + 1)), 6))


EVIDENCE_SQL = f"(SELECT sha256({NORM_SQL}) AS evidence, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first_id, round(least(5.0, log2(count(*) + 1)), 6)::DOUBLE AS boost FROM documents WHERE text IS NOT NULL GROUP BY 1)"


@query(f"SELECT evidence, n, sources, boost FROM {EVIDENCE_SQL} ORDER BY n DESC, evidence LIMIT 10")
def a2_top_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir).select("evidence", "n", "sources", "boost").orderBy(F.desc("n"), "evidence").limit(10)


@query(f"SELECT * FROM {EVIDENCE_SQL}")
def a3_evidence_exact(spark, sf_dir):
    return _evidence(spark, sf_dir)


@query(f"SELECT first_id, n, sources, (CASE WHEN sources >= 2 THEN 0.85 ELSE 0.5 END)::DOUBLE AS tau_initial FROM {EVIDENCE_SQL}")
def a5_multi_source(spark, sf_dir):
    return _evidence(spark, sf_dir).select("first_id", "n", "sources", F.when(F.col("sources") >= 2, 0.85).otherwise(0.5).alias("tau_initial"))


@query(f"SELECT first_id, boost FROM {EVIDENCE_SQL} WHERE n > 1")
def a6_evidence_boost(spark, sf_dir):
    return _evidence(spark, sf_dir).where("n > 1").select("first_id", "boost")


@query("SELECT o_orderpriority AS strategy, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS resolved, count(*) FILTER (o_orderstatus <> 'F') AS unresolved FROM orders GROUP BY 1")
def a7_conflict_breakdown(spark, sf_dir):
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("strategy")).agg(F.count("*").alias("total"), F.count_if(done).alias("resolved"), F.count_if(~done).alias("unresolved"))


@query(f"""SELECT namespace AS grp, source AS value, round(sum(CASE source_type WHEN 'direct' THEN 1.0 WHEN 'tool' THEN 0.7 ELSE 0.5 END) + CASE WHEN count(*) >= 2 THEN 0.1 * (count(*) - 1) ELSE 0 END, 6)::DOUBLE AS score
FROM {EPISODES_SQL} GROUP BY ALL""")
def a8_profile_scores(spark, sf_dir):
    weight = F.when(F.col("source_type") == "direct", 1.0).when(F.col("source_type") == "tool", 0.7).otherwise(0.5)
    n = F.count("*")
    return episodes(spark, sf_dir).groupBy(F.col("namespace").alias("grp"), F.col("source").alias("value")).agg(F.round(F.sum(weight) + F.when(n >= 2, 0.1 * (n - 1)).otherwise(0.0), 6).alias("score"))


@query(f"SELECT namespace, id, source, tau_initial FROM {EPISODES_SQL} QUALIFY row_number() OVER (PARTITION BY left(content, 100) ORDER BY least(1.0, tau_initial * CASE WHEN fact_track = 'core' THEN 1.1 ELSE 1.0 END) DESC, id) = 1")
def a20_dedup_best(spark, sf_dir):
    score = F.least(F.lit(1.0), F.col("tau_initial") * F.when(F.col("fact_track") == "core", 1.1).otherwise(1.0))
    e = episodes(spark, sf_dir).withColumn("prefix", F.substring("content", 1, 100)).drop("content")
    return R.dedup_best(e, ["prefix"], score, "id").select("namespace", "id", "source", "tau_initial")


@query("""SELECT event_id, rate, same, rate > 20 AS spike, same > 5 AS flood FROM (SELECT event_id,
 count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS rate,
 count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) AS same FROM events)""")
def a22_rate_and_repeat(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rate = F.count("*").over(W.partitionBy("user_id").orderBy(at).rangeBetween(-60_000_000, 0))
    same = F.count("*").over(W.partitionBy("user_id", "event_type").orderBy(at).rangeBetween(-300_000_000, 0))
    return table(spark, sf_dir, "events").select("event_id", rate.alias("rate"), same.alias("same"), (rate > 20).alias("spike"), (same > 5).alias("flood"))


@query("""WITH r AS (SELECT user_id, count(*) AS n, avg(least(1.0, value / 500)) AS s, count(DISTINCT event_type) AS d FROM events GROUP BY 1)
SELECT user_id, round(0.4 * least(1.0, n / 10.0) + 0.4 * s + 0.2 * least(1.0, d / 5.0), 6)::DOUBLE AS quality FROM r""")
def a16_retrieval_quality(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg(F.least(F.lit(1.0), F.col("value") / 500)).alias("s"), F.countDistinct("event_type").alias("d"))
    return g.select("user_id", F.round(0.4 * F.least(F.lit(1.0), F.col("n") / 10) + 0.4 * F.col("s") + 0.2 * F.least(F.lit(1.0), F.col("d") / 5), 6).alias("quality"))


# --- sort, limit, sets


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def t1_top_by_one_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 25")
def t2_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy("o_orderdate", "o_orderkey").offset(25).limit(10).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice - 100000 AS score FROM orders WHERE o_totalprice > 100000 ORDER BY score DESC, o_orderkey LIMIT 25")
def t3_global_top_k(spark, sf_dir):
    """The best of all by score, none of 0 or less; each task keeps its own 25 before they meet."""
    score = F.col("o_totalprice") - 100000
    return table(spark, sf_dir, "orders").select("o_orderkey", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "o_orderkey").limit(25)


@query(f"SELECT source, id FROM {EPISODES_SQL} WHERE tau_initial > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY tau_initial DESC, id) <= 3")
def t4_top_per_key(spark, sf_dir):
    return R.top_k(episodes(spark, sf_dir).where("tau_initial > 0").select("source", "id", "tau_initial"), ["source"], "tau_initial", "id", 3).select("source", "id")


@query("""WITH r AS (SELECT o_custkey AS q, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey * 7919) % 1009 END AS score FROM orders),
h AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) AS slot, row_number() OVER (PARTITION BY q ORDER BY score DESC, rank) AS best FROM r WHERE rank <= 5 AND score IS NOT NULL)
SELECT a.q, a.id, b.rank::INT AS rank FROM h a JOIN h b ON a.q = b.q AND a.best = b.slot UNION ALL SELECT q, id, rank::INT FROM r WHERE NOT (rank <= 5 AND score IS NOT NULL)""")
def t5_head_rerank(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = R.top_k(o.select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("s")), ["q"], "s", "id", 2**31 - 1)
    scored = r.withColumn("score", F.when(F.col("id") % 5 != 0, F.col("id") * 7919 % 1009))
    return R.head_rerank(scored, ["q"], 5, F.col("score")).select("q", "id", "rank")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) <= CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 3 ELSE 2 END")
def t6_channel_caps(spark, sf_dir):
    cap = F.when(F.col("event_type") == "click", 5).when(F.col("event_type") == "view", 3).otherwise(2)
    w = W.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where((F.col("k") <= 5) & (F.col("k") <= cap)).select("user_id", "event_type", "event_id")


@query("SELECT c_custkey AS id, 'customer' AS channel FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def u1_union_channels(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("channel"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("channel"), F.col("s_suppkey").alias("id")), allowMissingColumns=True)


@query("""WITH r AS (SELECT doc_id AS id, n_chars / 10.0 AS score FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, n_chars / 20.0 + 7 FROM documents WHERE doc_id % 3 = 0) SELECT id, max(score)::DOUBLE AS score FROM r GROUP BY id""")
def u2_union_of_retrievals(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 10).alias("score"))
    b = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 20 + 7).alias("score"))
    return a.union(b).groupBy("id").agg(F.max("score").alias("score"))


TOKENS_SQL = "list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> ''))"


@query(f"""WITH t AS (SELECT item_id, {TOKENS_SQL} AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6)::DOUBLE AS jaccard FROM t a JOIN t b ON a.item_id + 1 = b.item_id""")
def u3_jaccard(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: x != "")).alias("w"))
    j = b.select(F.col("item_id").alias("a"), F.col("w").alias("x")).join(b.select(F.col("item_id").alias("b"), F.col("w").alias("y")), F.col("a") + 1 == F.col("b"))
    return j.select("a", "b", F.round(R.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def u4_new_anchors(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").distinct().join(o.where("o_orderstatus = 'F'").select("o_custkey"), "o_custkey", "left_anti")


@query("WITH w AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY 1, 2) SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS words FROM f GROUP BY 1")
def u5_ordered_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(F.array_distinct(F.split(F.lower("text"), " ")), " ").alias("words"))


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F'")
def u6_intersect(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey").intersect(li.where("l_linestatus = 'F'").select("l_partkey"))
