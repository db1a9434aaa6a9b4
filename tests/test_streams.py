"""Streaming jobs over several micro-batches against the same over all rows at once: state, expiry, late rows, replayed batches."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemex.shared import Workspace
from mnemex.streaming import jobs as J


def write(spark, tmp_path, files, name="events"):
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string, value double")
        df.withColumn("ts", F.timestamp_seconds(1704067200 + F.col("ts"))).coalesce(1).write.parquet(f"{tmp_path}/{name}/part={i}")
        for p in (tmp_path / name / f"part={i}").glob("*.parquet"):
            p.rename(tmp_path / name / f"{i}.parquet")
        shutil.rmtree(tmp_path / name / f"part={i}")
    return f"{tmp_path}/{name}"


def in_order(n=400, files=5, seed=1):
    r = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += r.choice((1, 5, 40, 400))
        rows.append((i, at, 1 if r.random() < 0.5 else r.randrange(2, 6), r.choice(("error", "view", "click")), r.gauss(0, 100)))
    return [rows[k * n // files : (k + 1) * n // files] for k in range(files)]


def plain(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_windows_keep_the_last_write(spark, tmp_path):
    path = write(spark, tmp_path, in_order())
    every = spark.read.parquet(path)
    ws = Workspace(spark, "test")
    stream = lambda: J.read_events(spark, path, files=1)
    got = J.run_once(J.minute_counts(stream()), ws, "counts", "update", ["start", "user_id"])
    assert got.agg(F.sum("n")).first()[0] == 400
    assert plain(got) == plain(every.groupBy(F.window("ts", "60 seconds").start.alias("start"), "user_id").agg(F.count("*").alias("n")).select("start", "user_id", "n"))
    got = J.run_once(J.rate_windows(stream(), limit=2), ws, "rates", "update", ["start", "user_id"])
    assert plain(got) == plain(J.rate_windows(every, limit=2))
    got = J.run_once(J.tumbling_hyperedges(stream()), ws, "edges", "update", ["start", "user_id"])
    assert plain(got) == plain(every.groupBy(F.window("ts", "300 seconds").start.alias("start"), "user_id").agg(F.countDistinct("event_id").cast("int").alias("n")).select("start", "user_id", "n"))
    got = J.run_once(J.sessions(stream(), 300), ws, "sessions", "update", ["start", "user_id"]).where("n > 0")
    assert plain(got) == plain(every.groupBy(F.session_window("ts", "300 seconds").alias("w"), "user_id").agg(F.count("*").alias("n")).select("w.start", "w.end", "user_id", "n"))


def test_sessions_that_late_writes_join(spark, tmp_path):
    files = [[(1, 1000, 1, "v", 0.0), (2, 1500, 1, "v", 0.0)], [(3, 1250, 1, "v", 0.0)], [(4, 950, 1, "v", 0.0)], [(5, 5000, 2, "v", 0.0)], [(6, 1260, 1, "v", 0.0)], [(7, 5100, 1, "v", 0.0)]]
    path = write(spark, tmp_path, files)
    got = J.run_once(J.sessions(J.read_events(spark, path, files=1), 300), Workspace(spark, "test"), "sessions", "update", ["start", "user_id"]).where("n > 0")
    base = 1704067200
    assert sorted((int(r.start.timestamp()) - base, int(r.end.timestamp()) - base, r.user_id, r.n) for r in got.select("start", "end", "user_id", "n").collect()) == [(950, 1800, 1, 5), (5000, 5300, 2, 1), (5100, 5400, 1, 1)]


def test_keyed_state_over_batches(spark, tmp_path):
    files = in_order(seed=2)
    path = write(spark, tmp_path, files)
    ws = Workspace(spark, "test")
    trust, gate = {}, {}
    for _, _, u, kind, v in sum(files, []):
        t, n = trust.get(u, (1.0, 0))
        trust[u] = min(1.0, max(0.0, t + (-0.2 if kind == "error" else 0.05))), n + 1
        gate[u] = J.gate_step(gate.get(u, (0.0, 0.0, 0.9, 0.0, 0, 0)), v / 100, kind != "error", 10, 0.5)
    got = J.run_once(J.trust_state(J.read_events(spark, path, files=1)), ws, "trust", "update", ["user_id"]).collect()
    assert {r.user_id: (r.trust, r.writes) for r in got} == {u: (pytest.approx(t), n) for u, (t, n) in trust.items()} and len(got) == len(trust)
    got = J.run_once(J.learning_gate(J.read_events(spark, path, files=1)), ws, "gate", "update", ["user_id"]).collect()
    assert {r.user_id: (r.weight, r.alpha, r.kept, r.n) for r in got} == {u: (pytest.approx(g[1], abs=1e-6), pytest.approx(g[2], abs=1e-6), g[5], g[4]) for u, g in gate.items()}
    assert any(g[5] < g[4] for g in gate.values())


def test_sliding_history_over_batches(spark, tmp_path):
    path = write(spark, tmp_path, in_order(seed=3))
    got = J.run_once(J.sliding_history(J.read_events(spark, path, files=1), 300), Workspace(spark, "test"), "history")
    every = spark.read.parquet(path)
    w = W.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-300_000_000, 0)
    assert plain(got) == plain(every.select("event_id", "user_id", F.count("*").over(w).alias("n")))


def test_late_writes(spark, tmp_path):
    """A write that comes after younger ones counts what lies before it; one behind the watermark is dropped; what is out of reach has expired."""
    files = [[(1, 1000, 1, "v", 0.0), (2, 1100, 1, "v", 0.0)], [(3, 1050, 1, "v", 0.0)], [(4, 1200, 1, "v", 0.0), (5, 9000, 2, "v", 0.0)], [(6, 20_000, 2, "v", 0.0)], [(7, 1300, 1, "v", 0.0), (8, 20_010, 1, "v", 0.0)]]
    path = write(spark, tmp_path, files)
    got = J.run_once(J.sliding_history(J.read_events(spark, path, files=1), 300), Workspace(spark, "test"), "history")
    assert sorted((r.event_id, r.n) for r in got.collect()) == [(1, 1), (2, 2), (3, 2), (4, 4), (5, 1), (6, 1), (8, 1)]


def test_vectors_of_replayed_batches(spark, tmp_path):
    """A batch that runs again replaces itself; a later text of an id replaces its vector; what is put aside writes nothing."""
    home = tmp_path / "texts"

    def arrive(name, rows):
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.parquet(f"{home}/{name}-dir")
        for p in (home / f"{name}-dir").glob("*.parquet"):
            p.rename(home / f"{name}.parquet")
        shutil.rmtree(home / f"{name}-dir")

    arrive("a", [(1, "one two two"), (2, "aside"), (3, ""), (None, "no id"), (4, None), (5, "same text"), (5, "same text")])
    ws, encode = Workspace(spark, "test"), J.hashed_words(16)(F.col("text"))
    aside = lambda: spark.createDataFrame([(2,)], "id long")
    run = lambda: {r.id: tuple(r.vector) for r in J.embed_batches(J.read_files(spark, str(home), files=1), aside, encode, ws).collect()}
    first = run()
    assert set(first) == {1, 5} and run() == first  # nothing new
    arrive("b", [(1, "other words here"), (6, "six")])
    second = run()
    assert set(second) == {1, 5, 6} and second[1] != first[1] and second[5] == first[5]
    # the last batch is run again, as after a failure before its commit
    commits = Path(ws.path("vectors-checkpoint").removeprefix("file:") + "/commits")
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in last.parent.glob(f"*{last.name}*"):
        p.unlink()
    assert run() == second
    assert J.stored_vectors(spark, ws).count() == 3
