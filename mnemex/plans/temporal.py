"""Version chains, windows and decay."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import temporal as T
from ..sources.tables import EPISODES_SQL, MEMBERS_SQL, VERSIONS_SQL, episodes, members, property_versions, table
from .catalog import query

SECONDS_SQL = "epoch(TIMESTAMP '2024-02-01' - created_at)"


def moment(text: str):
    return F.lit(text).cast("timestamp")


def age(column: str = "created_at"):
    return (F.unix_micros(moment("2024-02-01 00:00:00")) - F.unix_micros(F.col(column).cast("timestamp"))) / 1e6


@query(f"SELECT id, value, valid_from FROM {VERSIONS_SQL} WHERE entity_id = 7 AND attr_name = 'click' ORDER BY valid_from")
def s5_property_versions(spark, sf_dir):
    return property_versions(spark, sf_dir).where("entity_id = 7 AND attr_name = 'click'").orderBy("valid_from").select("id", "value", "valid_from")


@query("SELECT DISTINCT event_type AS attr_name FROM events")
def s7_distinct_attributes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("attr_name")).distinct()


@query(f"""SELECT entity_id, attr_name, id, value, valid_from FROM {VERSIONS_SQL}
WHERE valid_from <= TIMESTAMP '2024-01-15' AND (expired_at IS NULL OR expired_at > TIMESTAMP '2024-01-15')
QUALIFY row_number() OVER (PARTITION BY entity_id, attr_name ORDER BY valid_from DESC, id DESC) = 1""")
def j9_as_of_version(spark, sf_dir):
    return T.as_of(property_versions(spark, sf_dir), moment("2024-01-15 00:00:00"))


@query(f"""SELECT q.o_orderkey, v.attr_name, v.value FROM (SELECT o_orderkey, o_custkey % 150 AS entity_id, TIMESTAMP '2024-01-01' + to_minutes(o_orderkey % 43200) AS at FROM orders) q
JOIN {VERSIONS_SQL} v ON v.entity_id = q.entity_id AND v.valid_from <= q.at AND (v.expired_at IS NULL OR v.expired_at > q.at)
QUALIFY row_number() OVER (PARTITION BY o_orderkey, attr_name ORDER BY valid_from DESC, id DESC) = 1""")
def j9_as_of_join(spark, sf_dir):
    """Each order asks for its customer's properties at its own time: equi-join on the entity, range residual, newest by aggregate."""
    k = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(k, (F.col("o_custkey") % 150).alias("entity_id"), F.timestamp_seconds(F.lit(1704067200) + k % 43200 * 60).alias("at"))
    v = property_versions(spark, sf_dir)
    hit = asked.join(v, "entity_id").where((F.col("valid_from") <= F.col("at")) & (F.col("expired_at").isNull() | (F.col("expired_at") > F.col("at"))))
    return hit.groupBy("o_orderkey", "attr_name").agg(F.max(F.struct("valid_from", "id", "value")).alias("v")).select("o_orderkey", "attr_name", "v.value")


@query(f"SELECT entity_id, attr_name, id, value, valid_from FROM {VERSIONS_SQL} WHERE expired_at IS NULL QUALIFY row_number() OVER (PARTITION BY entity_id, attr_name ORDER BY valid_from DESC, id DESC) = 1")
def w1_latest_version(spark, sf_dir):
    return T.latest(property_versions(spark, sf_dir))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) <= 8")
def w2_keep_last_versions(spark, sf_dir):
    return T.keep_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], 8).select("event_id")


@query("""WITH r AS (SELECT event_id AS id, user_id AS entity_id, event_type AS attr_name, (event_id % 3)::BIGINT AS value, ts AS valid_from FROM events),
c AS (SELECT *, lag(value) OVER (PARTITION BY entity_id, attr_name ORDER BY valid_from, id) AS old FROM r)
SELECT id, value, valid_from, lead(valid_from) OVER (PARTITION BY entity_id, attr_name ORDER BY valid_from, id) AS expired_at FROM c WHERE old IS NULL OR old <> value""")
def w3_version_chain(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("attr_name"), (F.col("event_id") % 3).alias("value"), F.col("ts").cast("timestamp").alias("valid_from"))
    return T.version_chain(raw).select("id", "value", "valid_from", "expired_at")


@query("""WITH s AS (SELECT user_id, event_id, ts, event_type, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_type, count(*) AS runs, count(*) >= 3 AS promoted, least(1.0, count(*) / 6.0)::DOUBLE AS confidence FROM s WHERE a = event_type AND b = event_type GROUP BY user_id, event_type""")
def w4_repeated_action(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.lag("event_type", 1).over(w).alias("a"), F.lag("event_type", 2).over(w).alias("b"))
    n = F.count("*")
    return e.where("a = event_type AND b = event_type").groupBy("user_id", "event_type").agg(n.alias("runs"), (n >= 3).alias("promoted"), F.least(F.lit(1.0), n / 6).alias("confidence"))


@query("""SELECT event_id, count(*) OVER m AS near, count(*) OVER h AS hour,
  count(*) OVER m >= 1 AS temporal, count(*) OVER h >= 4 AS episode
FROM events WINDOW m AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 300000000 PRECEDING AND 1 PRECEDING), h AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING)
""")
def w5_temporal_hyperedges(spark, sf_dir):
    """Neighbours of the same source within 5 minutes and within the hour; both frames share one sort."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id").orderBy(at)
    near, hour = F.count("*").over(w.rangeBetween(-300_000_000, -1)), F.count("*").over(w.rangeBetween(-3_600_000_000, -1))
    return table(spark, sf_dir, "events").select("event_id", near.alias("near"), hour.alias("hour"), (near >= 1).alias("temporal"), (hour >= 4).alias("episode"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, array_to_string(list_sort(list(event_id) FILTER (k <= 5)), ',') AS temporal_ids, CASE WHEN count(*) >= 4 THEN array_to_string(list_sort(list(event_id) FILTER (k <= 8)), ',') END AS episode_ids
FROM r GROUP BY user_id HAVING count(*) >= 2""")
def w6_batched_hyperedges(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    top = T.keep_last(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 8).withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    lists = top.groupBy("user_id").agg(F.sort_array(F.collect_list(F.when(F.col("k") <= 5, F.col("event_id")))).alias("t"), F.sort_array(F.collect_list("event_id")).alias("e"))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return n.join(lists, "user_id").where("n >= 2").select("user_id", text("t").alias("temporal_ids"), F.when(F.col("n") >= 4, text("e")).alias("episode_ids"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def w7_session_ring(spark, sf_dir):
    return T.keep_last(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn", "role")


@query(f"SELECT DISTINCT hyperedge_id AS src, episode_id AS dst FROM {MEMBERS_SQL} QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY hyperedge_id % 97 DESC, hyperedge_id) <= 8")
def w8_top_edges(spark, sf_dir):
    h = F.col("hyperedge_id")
    return T.keep_last(members(spark, sf_dir), ["episode_id"], [F.desc(h % 97), h], 8).select(h.alias("src"), F.col("episode_id").alias("dst"))


@query(f"""WITH m AS {MEMBERS_SQL}, s AS (SELECT hyperedge_id, count(*) AS n FROM m GROUP BY 1)
SELECT episode_id, hyperedge_id FROM m JOIN s USING (hyperedge_id) QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY n DESC, hyperedge_id) = 1""")
def w9_exclusive_community(spark, sf_dir):
    m = members(spark, sf_dir)
    sized = m.join(m.groupBy("hyperedge_id").agg(F.count("*").alias("n")), "hyperedge_id")
    best = sized.groupBy("episode_id").agg(F.max(F.struct("n", (-F.col("hyperedge_id")).alias("h"))).alias("b"))
    return best.select("episode_id", (-F.col("b.h")).alias("hyperedge_id"))


@query("""WITH RECURSIVE o AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, 0.3 * x AS q FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, 0.7 * r.q + 0.3 * o.x FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, round(arg_max(q, k), 4)::DOUBLE AS quality FROM r GROUP BY user_id""")
def w10_quality_ema(spark, sf_dir):
    """The recurrence unrolled: an event counts 0.3 times 0.7 to the number of later ones, so a sum does and no user's events are held in one row."""
    later = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))) - 1
    e = table(spark, sf_dir, "events").select("user_id", (0.3 * F.pow(F.lit(0.7), later) * F.col("value")).alias("part"))
    return e.groupBy("user_id").agg(F.round(F.sum("part"), 4).alias("quality"))


@query("""WITH p AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, avg((turn > before)::INT)::DOUBLE AS in_order FROM p WHERE before IS NOT NULL GROUP BY conv_id""")
def w11_order_check(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn")).alias("before"))
    return p.where("before IS NOT NULL").groupBy("conv_id").agg(F.avg((F.col("turn") > F.col("before")).cast("int")).alias("in_order"))


TAU_SQL = f"""(SELECT *, {SECONDS_SQL}::DOUBLE AS age, least(7200.0, greatest(300.0, 1800.0 * (1 + (id % 10) / 10.0 * 0.5 * 2.0) * (CASE WHEN fact_track = 'core' THEN 2.0 ELSE 1.0 END)
  * (CASE WHEN id % 20 > 5 THEN 1 + least(1.0, (id % 20) / 50.0) ELSE 1.0 END)))::DOUBLE AS win FROM {EPISODES_SQL})"""


def _decayed(spark, sf_dir):
    e = episodes(spark, sf_dir).drop("content")
    win = T.tau_window(F.col("id") % 10 / 10, F.col("fact_track") == "core", F.col("id") % 20)
    return e.withColumn("age", age()).withColumn("win", win).withColumn("tau", T.tau(F.col("tau_initial"), F.col("age") / 1000, F.col("win")))


@query(f"SELECT id, round(tau_initial * exp(-(age / 1000) / win), 6)::DOUBLE AS tau FROM {TAU_SQL}")
def g6_tau_decay(spark, sf_dir):
    return _decayed(spark, sf_dir).select("id", F.round("tau", 6).alias("tau"))


@query(f"""SELECT id, round(0.6 * tau_initial * exp(-(age / 1000) / win) + 0.4 * ((cos(2 * pi() * age / 60) + 1) / 2 + (cos(2 * pi() * age / 300) + 1) / 2 + (cos(2 * pi() * age / 1800) + 1) / 2
 + (cos(2 * pi() * age / 7200) + 1) / 2 + (cos(2 * pi() * age / 86400) + 1) / 2 + (cos(2 * pi() * age / 604800) + 1) / 2) / 6, 4)::DOUBLE AS strength FROM {TAU_SQL}""")
def g7_phase_strength(spark, sf_dir):
    s = T.phase_strength(F.col("tau"), F.col("age"), [60, 300, 1800, 7200, 86400, 604800], 0.6)
    return _decayed(spark, sf_dir).select("id", F.round(s, 4).alias("strength"))


@query(f"""WITH t AS (SELECT *, tau_initial * exp(-(age / 1000) / win) AS tau FROM {TAU_SQL})
SELECT id FROM t WHERE tau < 0.1 AND NOT (id % 10 / 10.0 > 0.7 AND tau >= 0.05) AND NOT id % 6 > 3""")
def g8_decay_candidates(spark, sf_dir):
    return _decayed(spark, sf_dir).where(T.is_decayed(F.col("tau"), F.col("id") % 10 / 10, F.col("id") % 6)).select("id")


@query(f"""WITH t AS (SELECT *, tau_initial * exp(-(age / 1000) / win) AS tau FROM {TAU_SQL}),
p AS (SELECT *, tau < 0.1 AND NOT (protected OR age < 7200 OR tau > 0.3 OR id % 6 > 1) AS gone FROM t)
SELECT id FROM p WHERE NOT gone OR (SELECT avg(gone::INT) FROM p) > 0.5""")
def g10_prune_with_guard(spark, sf_dir):
    return T.prune(_decayed(spark, sf_dir), T.is_prunable(F.col("tau"), F.col("protected"), F.col("age"), F.col("id") % 6)).select("id")


@query("""WITH f AS (SELECT user_id, count(*) AS n, avg(value) AS mean, 1800.0 AS t0 FROM events GROUP BY user_id)
SELECT user_id, n, round(CASE WHEN n >= 10 THEN t0 + 0.01 * (mean - t0) ELSE t0 END, 4)::DOUBLE AS window_s FROM f""")
def g9_learned_window(spark, sf_dir):
    n = F.count("*")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(n.alias("n"), F.round(F.when(n >= 10, 1800.0 + 0.01 * (F.avg("value") - 1800.0)).otherwise(1800.0), 4).alias("window_s"))


@query(f"""SELECT hyperedge_id AS src, episode_id AS dst, round(CASE WHEN t < 0.1 THEN w * t / 0.1 ELSE w END, 6)::DOUBLE AS weight
FROM (SELECT hyperedge_id, episode_id, (episode_id % 50) / 50.0 AS w, coalesce(tau_initial, 0.5) AS t FROM {MEMBERS_SQL} m LEFT JOIN {EPISODES_SQL} e ON e.id = m.hyperedge_id)""")
def g13_attenuate_edges(spark, sf_dir):
    e = episodes(spark, sf_dir).select(F.col("id").alias("hyperedge_id"), "tau_initial")
    t, w = F.coalesce("tau_initial", F.lit(0.5)), F.col("episode_id") % 50 / 50
    joined = members(spark, sf_dir).join(e, "hyperedge_id", "left")
    return joined.select(F.col("hyperedge_id").alias("src"), F.col("episode_id").alias("dst"), F.round(F.when(t < 0.1, w * t / 0.1).otherwise(w), 6).alias("weight"))


@query(f"SELECT source, count(*) AS n, round(avg(tau_initial), 6)::DOUBLE AS mean_tau, round(avg(id % 20), 6)::DOUBLE AS mean_access FROM {EPISODES_SQL} GROUP BY source")
def a19_decay_statistics(spark, sf_dir):
    return episodes(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("tau_initial"), 6).alias("mean_tau"), F.round(F.avg(F.col("id") % 20), 6).alias("mean_access"))


@query(f"SELECT id, round(tau_initial * (1 + 1 / (1 + exp(-tau_initial / 60))), 6)::DOUBLE AS boosted FROM {EPISODES_SQL}")
def v14_tau_boost(spark, sf_dir):
    t = F.col("tau_initial")
    return episodes(spark, sf_dir).select("id", F.round(t * (1 + 1 / (1 + F.exp(-t / 60))), 6).alias("boosted"))
