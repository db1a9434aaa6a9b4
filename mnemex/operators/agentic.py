"""Retrieval in several rounds: what the results name becomes the next question.

Questions that aren't answered yet are the frontier. A round retrieves for all of them at once; anchors are read from the best results, compared with those the question has followed before (an anti-join), and the questions with enough new ones go on. Frontier,
results and anchors are tables written each round, so a round starts from files and a lost executor costs one round. What grows is the number of questions, never of rows a question.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..shared import Workspace, within
from .ranking import top_k


def anchors(results: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """``query_id, entities, attributes, time, anchors`` of results (query_id, rank, content), best first: up to ``most`` entities, all attribute words, and the first time that a result means, as a label that doesn't move with the clock where it has one, else as seconds.
    ``anchors`` holds all of them, in this order."""
    mode, at = X.time_mode(F.col("content"), now)
    time = F.when(at.isNotNull(), F.concat(F.lit("time:"), F.coalesce(X.time_key(F.col("content")), F.unix_timestamp(at).cast("string"))))
    read = results.select("query_id", "rank", X.query_entities(F.col("content"), most).alias("e"), X.attribute_terms(F.col("content")).alias("a"), time.alias("t"))
    got = read.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "e", "a", "t"))).alias("r"))
    of = lambda name: F.transform("r", lambda x: x[name])
    entities, attributes = X.first_distinct(F.flatten(of("e")), most), F.array_distinct(F.flatten(of("a")))
    first = F.try_element_at(F.filter(of("t"), lambda x: x.isNotNull()), F.lit(1))
    out = got.select("query_id", entities.alias("entities"), attributes.alias("attributes"), first.alias("time"))
    timed = F.when(F.col("time").isNotNull(), F.array("time")).otherwise(F.array().cast("array<string>"))
    return out.withColumn("anchors", F.concat(F.array_distinct(F.concat("entities", "attributes")), timed))


def sufficient(results: DataFrame) -> DataFrame:
    """``query_id, n, enough`` of results (query_id, id, score): enough if scores fall by a quarter and three results differ."""
    g = results.groupBy("query_id").agg(F.max("score").alias("hi"), F.min("score").alias("lo"), F.countDistinct("id").alias("n"))
    return g.select("query_id", "n", ((F.col("hi") > 0) & ((F.col("hi") - F.col("lo")) / F.col("hi") >= 0.25) & (F.col("n") >= 3)).alias("enough"))


def agentic(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], contents: DataFrame, now: Column, steps: int = 3, top: int = 12, least_new: int = 3) -> DataFrame:
    """``query_id, id, score, step`` of all rounds, each result once with the score and round that found it.

    ``retrieve`` takes (query_id, text) and gives (query_id, id, score); ``contents`` are (id, content). A question stops when its ``top`` results are enough, when fewer than ``least_new`` anchors are new to it, or after ``steps`` rounds."""
    ws = Workspace(queries.sparkSession, "agentic")
    asked = queries.select("query_id", "text")
    found: list[DataFrame] = []
    seen: list[DataFrame] = []
    for step in range(1, steps + 1):
        hits = retrieve(asked).select("query_id", "id", "score")
        if found:
            hits = hits.join(reduce(DataFrame.union, found).select("query_id", "id"), ["query_id", "id"], "left_anti")
        found.append(ws.save(hits.withColumn("step", F.lit(step)), f"hits-{step}"))
        if step == steps:
            break
        head = top_k(reduce(DataFrame.union, found).join(asked.select("query_id"), "query_id", "left_semi"), ["query_id"], "score", "id", top)
        head = ws.save(head, f"head-{step}")
        more = head.join(sufficient(head).where("NOT enough").select("query_id"), "query_id", "left_semi")
        named = ws.save(anchors(more.join(contents, "id").select("query_id", "rank", "content"), now), f"anchors-{step}")
        every = named.select("query_id", F.explode(F.array_distinct(F.transform("anchors", lambda x: F.lower(x)))).alias("anchor"))
        new = every.join(reduce(DataFrame.union, seen), ["query_id", "anchor"], "left_anti") if seen else every
        go = ws.save(new.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least_new).select("query_id"), f"go-{step}")
        if within(go, 0):
            break
        seen.append(every.join(go, "query_id", "left_semi"))
        asked = ws.save(named.join(go, "query_id", "left_semi").select("query_id", F.array_join(F.array_distinct(F.concat("entities", "attributes")), " ").alias("text")), f"asked-{step}")
    return reduce(DataFrame.union, found)
