"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import Workspace
from ..streaming import jobs as J
from .catalog import query
from .governance import TRUST_SQL
from .retrieval import WORDS_SQL


def _events(spark, sf_dir):
    return J.read_events(spark, f"{sf_dir}/events.parquet")


EPOCH_SQL = "TIMESTAMP '1970-01-01'"


@query(f"SELECT {EPOCH_SQL} + to_seconds((epoch_us(ts) // 60000000) * 60) AS start, user_id, count(*) AS n FROM events GROUP BY ALL")
def stream_minute_counts(spark, sf_dir):
    return J.run_once(J.minute_counts(_events(spark, sf_dir)), Workspace(spark, "stream"), "counts", "update", ["start", "user_id"])


@query(f"SELECT {EPOCH_SQL} + to_seconds((epoch_us(ts) // 10000000 - k) * 10) AS start, user_id, count(*) AS n, count(*) > 20 AS spike FROM events, range(6) r(k) GROUP BY ALL")
def stream_rate_windows(spark, sf_dir):
    return J.run_once(J.rate_windows(_events(spark, sf_dir)), Workspace(spark, "stream"), "rates", "update", ["start", "user_id"])


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    """All sessions, those that are still open too: keyed state with timers."""
    return J.run_once(J.sessions(_events(spark, sf_dir)), Workspace(spark, "stream"), "sessions", "update", ["start", "user_id"]).where("n > 0")


@query(f"SELECT {EPOCH_SQL} + to_seconds((epoch_us(ts) // 300000000) * 300) AS start, user_id, count(DISTINCT event_id)::INT AS n FROM events GROUP BY ALL HAVING count(DISTINCT event_id) >= 2")
def stream_temporal_hyperedges(spark, sf_dir):
    return J.run_once(J.tumbling_hyperedges(_events(spark, sf_dir)), Workspace(spark, "stream"), "hyperedges", "update", ["start", "user_id"]).where("n >= 2")


@query(TRUST_SQL)
def stream_trust_state(spark, sf_dir):
    return J.run_once(J.trust_state(_events(spark, sf_dir)), Workspace(spark, "stream"), "trust", "update", ["user_id"])


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM events")
def stream_sliding_history(spark, sf_dir):
    """Writes of each source in the six hours up to each write; times that no write may ask for any more expire."""
    return J.run_once(J.sliding_history(_events(spark, sf_dir), 6 * 3600), Workspace(spark, "stream"), "history", "append")


@query("""WITH RECURSIVE o AS (SELECT user_id, value / 100 AS x, event_type <> 'error' AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 0.0::DOUBLE AS h, 0.0::DOUBLE AS w, 0.9::DOUBLE AS a, 0.0::DOUBLE AS reward, 0::BIGINT AS kept FROM events
UNION ALL SELECT user_id, k, h, w + 0.5 * (good::INT - p) * h, CASE WHEN (p > 0.5) = good THEN greatest(0.3, a - 0.01) ELSE a END, 0.9 * reward + CASE WHEN (p > 0.5) = good THEN 1 ELSE -1 END,
 kept + (k <= 10 OR abs(reward) <= 1e-9 OR a / (1 + exp(-h)) + (1 - a) * p > 0.5)::INT
FROM (SELECT user_id, k, h, w, a, reward, kept, good, 1 / (1 + exp(-w * h)) AS p FROM (SELECT r.user_id, o.k, 0.9 * r.h + 0.1 * (exp(o.x) - exp(-o.x)) / (exp(o.x) + exp(-o.x)) AS h, r.w, r.a, r.reward, r.kept, o.good FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)))
SELECT user_id, round(arg_max(w, k), 6)::DOUBLE AS weight, round(arg_max(a, k), 6)::DOUBLE AS alpha, max(kept) AS kept, max(k) AS n FROM r GROUP BY user_id""")
def stream_learning_gate(spark, sf_dir):
    """The write gate with its online learning: state, weight and mixture of each source go from batch to batch."""
    return J.run_once(J.learning_gate(_events(spark, sf_dir)), Workspace(spark, "stream"), "gate", "update", ["user_id"])


@query(f"""WITH w AS (SELECT doc_id AS id, ('0x' || left(md5(term), 8))::BIGINT % 64 AS dim, count(*)::DOUBLE AS x FROM (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) GROUP BY ALL)
SELECT id, count(*)::INT AS filled, round(max(x) / sqrt(sum(x * x)), 6)::DOUBLE AS greatest, arg_max(dim, x * 1000 - dim)::INT AS at FROM w GROUP BY id""")
def w15_embedding_batch(spark, sf_dir):
    """Texts are encoded as they arrive, in micro-batches; those whose label puts them aside write no vector."""
    texts = J.read_files(spark, f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    aside = lambda: spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("id"))
    v = J.embed_batches(texts, aside, J.hashed_words()(F.col("text")), Workspace(spark, "stream"))
    return v.select("id", F.size(F.filter("vector", lambda x: x > 0)).alias("filled"), F.round(F.array_max("vector"), 6).alias("greatest"), (F.array_position("vector", F.array_max("vector")) - 1).cast("int").alias("at"))
