"""A consolidation run: what it decides, and that it goes on where it was cut off."""

import hashlib
import shutil
from pathlib import Path

from pyspark.sql import functions as F

from mnemex.operators.consolidation import consolidate
from mnemex.shared import Workspace

STAGES = ["gather", "cluster", "synthesise", "compress", "prune", "resolve", "persist", "report"]


def example(spark):
    fresh, old = (0.5, False, 100.0), (0.01, False, 1e6)
    rows = [
        (1, "Same words here", "a", *fresh, 2), (2, " same WORDS here", "b", 0.9, False, 100.0, 2), (3, "other words", "a", *fresh, 2), (4, "same words here", "c", *fresh, 2),  # one community, three equal contents
        (5, "same words here", "a", *fresh, 2), (6, "far away", "d", *old, 0), (7, "far and kept", "d", 0.01, True, 1e6, 0),  # another one; one faded, one protected
        (8, "alone", "a", *old, 0), (9, None, None, *fresh, 2), (10, "aside", "a", *fresh, 2),
    ]
    nodes = spark.createDataFrame(rows, "id long, content string, source string, tau double, protected boolean, age double, degree int").withColumn("quarantine", F.col("id") == 10)
    edges = [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (1, 4, 1.0), (5, 6, 1.0), (6, 7, 1.0), (5, 7, 1.0), (9, 10, 1.0), (4, 5, 0.01)]
    return nodes, spark.createDataFrame(edges, "src long, dst long, weight double")


def test_what_a_run_decides(spark):
    nodes, edges = example(spark)
    root = Workspace(spark, "test").path("run")
    report, run = consolidate(nodes, edges, root)
    assert run.ran == STAGES
    r = report.first()
    assert (r.communities, r.members, r.pruned, r.conflicts, r.updated, r.size_before, r.size_after) == (2, 7, 2, 2, 1, 9, 5)
    after = {x.id: (x.content, x.community, x.archived, x.merged_into, x.version) for x in spark.read.parquet(f"{root}/persist").collect()}
    assert after == {
        1: ("Same words here", 1, True, 2, 1), 2: (" same WORDS here | merged: Same words here", 1, False, None, 2), 3: ("other words", 1, False, None, 1), 4: ("same words here", 1, True, 2, 1),
        5: ("same words here", 5, False, None, 1), 6: ("far away", 5, True, None, 1), 7: ("far and kept", 5, False, None, 1), 8: ("alone", None, True, None, 1), 9: (None, None, False, None, 1),
    }
    reports = {x.community: x for x in spark.read.parquet(f"{root}/compress").collect()}
    assert reports[5].report == "Community 5: 3 members. same words here; far away; far and kept" and list(reports[5].topics) == ["a", "d"]
    assert list(reports[5].keywords) == ["away", "community", "here", "kept", "members", "same", "words"] and list(reports[1].episodes) == [1, 2, 3, 4]
    counts = "|".join(f"{k}={r[k]}" for k in ("communities", "members", "topics", "episodes", "keywords", "pruned", "conflicts", "updated", "size_before", "size_after"))
    assert r.hash == hashlib.sha256(f"{'0' * 64}|{counts}|1970-01-01 00:00:00".encode()).hexdigest()


def test_a_run_goes_on_where_it_was_cut_off(spark):
    nodes, edges = example(spark)
    root = Workspace(spark, "test").path("run")
    first = consolidate(nodes, edges, root)[0].first()
    report, run = consolidate(nodes, edges, root)
    assert run.ran == [] and report.first() == first  # nothing left to do
    home = Path(root.removeprefix("file:").replace("//", "/", 1))
    shutil.rmtree(home / "prune")  # a stage is lost
    report, run = consolidate(nodes, edges, root)
    assert run.ran == STAGES[4:] and report.first() == first
    (home / "synthesise" / "_SUCCESS").unlink()  # a stage was cut off before its commit
    report, run = consolidate(nodes, edges, root)
    assert run.ran == STAGES[2:] and report.first() == first


def test_guards_and_empty_runs(spark):
    nodes, edges = example(spark)
    root = Workspace(spark, "test").path("run")
    assert consolidate(nodes, edges, root, most_pruned=0.2)[0].first().pruned == 0  # too many would go
    none = consolidate(nodes.where("false"), edges, Workspace(spark, "test").path("none"))[0].first()
    assert (none.communities, none.size_before, none.size_after) == (0, 0, 0)
    single = consolidate(nodes, edges.where("false"), Workspace(spark, "test").path("single"))[0].first()
    assert (single.communities, single.conflicts, single.pruned) == (0, 0, 2)
