"""Cosine of TF-IDF vectors over character grams: a block of queries against all documents, without a row for each posting.

One pass counts in how many documents each gram stands; a task adds up its own documents first, so what is shuffled is the vocabulary of a task, not its postings. The vocabulary then goes to all tasks if it has no more than ``LARGEST`` grams; a second
pass makes the vector of each document where its text is, multiplies it with the block's queries and lets only the k best of each query leave its task. Products come in short floats first, those of the grams that most queries hold from a dense matrix;
where that is no less than what may count, up to the error of such sums, the product is taken exactly. A larger vocabulary is joined as a table instead (a size switch; scores are the same).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Workspace, within
from .ranking import top_k
from .retrieval import char_grams, postings
from .vectors import SCALE
from .vectors import _rounded as rounded

LOW, HIGH = 2, 4
LARGEST = 2_000_000
BLOCK = 8192  # different queries a pass: grams of a text cost more than its products with hundreds of queries
CELLS = 4_000_000  # of a matrix in a task
COMMON = 1024  # grams that most queries hold
STEP = 1_000_000  # postings multiplied at once
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Different grams (as hashes) of a text in lower case and how often each stands, ascending; words are padded with a blank on both sides."""
    words = [w for w in SPACE.split(text or "") if w]
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    c = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    edge = (c[1:] == 32) & (c[:-1] == 32)  # between two words
    out, h, crosses = [], c, np.zeros(len(c), dtype=bool)
    for k in range(1, HIGH):
        crosses = crosses[: len(c) - k] | edge[k - 1 :]
        h = (h[: len(c) - k] ^ (h[: len(c) - k] >> np.uint64(29))) * FACTOR + c[k:]
        if k + 1 >= LOW:
            out.append(h[~crosses] * np.uint64(2) + np.uint64(1) if k % 2 else h[~crosses])
    own, times = np.unique(np.concatenate(out).view(np.int64), return_counts=True)
    return own, times.astype(np.float64)


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        own, n = np.unique(np.concatenate(held) if held else np.zeros(0, dtype=np.int64), return_counts=True)
        return pa.record_batch({"gram": pa.array(own), "n": pa.array(n.astype(np.int64))})

    for batch in batches:
        for text in batch.column(1):
            held.append(grams(text.as_py())[0])
            size += len(held[-1])
            if size > 4_000_000:
                yield out()
                held, size = [], 0
    yield out()


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of the stretches, one after the other."""
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)


class Asked:
    """A block of queries by gram: which queries hold it, with which weight (at unit length)."""

    def __init__(self, lines: list[tuple[int, np.ndarray, np.ndarray]]):
        self.ids = np.array([q for q, _, _ in lines], dtype=np.int64)
        gram, self.value = np.concatenate([g for _, g, _ in lines]), np.concatenate([w for _, _, w in lines])
        self.held = np.array([len(g) for _, g, _ in lines])
        line = np.repeat(np.arange(len(lines)), self.held)
        order = np.argsort(gram, kind="stable")
        self.line, self.weight = line[order].astype(np.int32), self.value[order]
        self.grams, self.number, self.sizes = np.unique(gram, return_inverse=True, return_counts=True)
        self.starts = np.cumsum(self.sizes) - self.sizes
        top = np.argsort(-self.sizes, kind="stable")[:COMMON]
        self.rank = np.full(len(self.grams), -1)
        self.rank[top] = np.arange(len(top))
        self.error = 2e-7 * (self.held.max() + 8)  # of a sum of as many short floats that is 1 at most
        self.dense = None

    def rough(self, at: np.ndarray, w: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Products, up to ``error``, of all queries with documents: numbers of grams, weights at unit length and documents."""
        if self.dense is None:  # made in each process, not sent
            self.dense = np.zeros((len(self.ids), int(self.rank.max()) + 1), dtype=np.float32)
            place = np.repeat(self.rank, self.sizes)
            self.dense[self.line[place >= 0], place[place >= 0]] = self.weight[place >= 0]
        rank = self.rank[at]
        x = np.zeros((self.dense.shape[1], rows), dtype=np.float32)
        x[rank[rank >= 0], row[rank >= 0]] = w[rank >= 0]
        out = self.dense @ x
        at, w, row = (v[rank < 0] for v in (at, w, row))
        n = self.sizes[at]
        cuts = np.searchsorted(np.cumsum(n), np.arange(STEP, n.sum() + STEP, STEP))
        for low, high in zip([0, *cuts], [*cuts, len(n)], strict=True):
            if high > low:
                own = n[low:high]
                place = _spread(self.starts[at[low:high]], own)
                first, last = row[low], row[high - 1] + 1  # documents follow each other
                cell = self.line[place] + np.repeat((row[low:high] - first) * len(self.ids), own)
                out[:, first:last] += np.bincount(cell, self.weight[place] * np.repeat(w[low:high], own), (last - first) * len(self.ids)).reshape(-1, len(self.ids)).T
        return out

    def exact(self, line: np.ndarray, of: np.ndarray, at: np.ndarray, w: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Products of these queries with these documents."""
        keys, begin, out = row * len(self.grams) + at, np.cumsum(self.held) - self.held, []
        step = max(1, STEP // int(self.held.max()))
        for i in range(0, len(line), step):
            own, n = line[i : i + step], self.held[line[i : i + step]]
            place = _spread(begin[own], n)
            key = np.repeat(of[i : i + step], n) * len(self.grams) + self.number[place]
            there = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[there] == key
            out.append(np.bincount(np.repeat(np.arange(len(own)), n)[hit], self.value[place[hit]] * w[there[hit]], len(own)))
        return np.concatenate(out) if out else np.zeros(0)


def _score(block, vocabulary, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, idf), asked = vocabulary.value, block.value
        step = min(2048, max(1, CELLS // len(asked.ids)))
        kept = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(asked.ids)
        least_of = np.full(len(asked.ids), least)
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                ids, made, norm = batch.column(0).to_numpy(), [], np.ones(batch.num_rows)
                for r, text in enumerate(batch.column(1)):
                    own, times = grams(text.as_py())
                    w = times * idf[np.searchsorted(known, own)]
                    norm[r] = np.sqrt(w @ w) if len(own) else 1.0
                    at = np.minimum(np.searchsorted(asked.grams, own), len(asked.grams) - 1)
                    hit = np.flatnonzero(asked.grams[at] == own)
                    made.append((at[hit], w[hit], np.full(len(hit), r)))
                at, w, row = (np.concatenate(x) for x in zip(*made, strict=True))
                rough = asked.rough(at, w / norm[row], row, batch.num_rows)
                low = least_of - asked.error - 2 / SCALE
                near = (rough >= low[:, None]) & (rough > 0)
                many = np.flatnonzero(near.sum(axis=1) > k)
                if len(many):
                    low[many] = np.maximum(low[many], np.partition(rough[many], batch.num_rows - k, axis=1)[:, batch.num_rows - k] - 2 * asked.error - 2 / SCALE)
                    near[many] &= rough[many] >= low[many][:, None]
                line, of = np.nonzero(near)
                if not len(line):
                    continue
                score = rounded(asked.exact(line, of, at, w, row) / norm[of])
                ends = np.flatnonzero(np.diff(line, prepend=-1))
                for first, last in zip(ends, [*ends[1:], len(line)], strict=True):
                    q = line[first]
                    found = np.concatenate([kept[q][0], ids[of[first:last]]]), np.concatenate([kept[q][1], score[first:last]])
                    best = np.lexsort((found[0], -found[1]))[:k]
                    kept[q] = found[0][best], found[1][best]
                    if len(best) == k:
                        least_of[q] = max(least, kept[q][1][-1])
        found = pa.array(np.concatenate([x for _, x in kept]))
        yield pa.record_batch({"first": pa.array(np.repeat(asked.ids, [len(x) for x, _ in kept])), "id": pa.array(np.concatenate([x for x, _ in kept])), "score": found})

    return run


def tfidf_cosine(queries: DataFrame, docs: DataFrame, k: int = 20, block: int = BLOCK, largest: int = LARGEST, least: float = 0.0) -> DataFrame:
    """``query_id, id, score, rank`` of (query_id, text) against (id, text), ids being integers: cosines above 0, of ``least`` or more, to six digits, both sides weighed by the documents' idf; queries are compared by the grams that some document has, equal ones once."""
    spark = docs.sparkSession
    ws = Workspace(spark, "tfidf")
    texts = docs.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.lower("text").alias("text"))
    df = ws.save(texts.mapInArrow(_holders, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "holders")
    if not within(df, largest):
        return _by_joins(queries, docs, k).where(F.col("score") >= least)
    n = texts.count()
    got = df.toArrow().sort_by("gram")  # bounded by ``largest``
    known, idf = got["gram"].to_numpy(), np.log((1 + n) / (1 + got["n"].to_numpy().astype(np.float64))) + 1
    vocabulary = spark.sparkContext.broadcast((known, idf))
    asked = ws.save(queries.where("query_id IS NOT NULL").select("query_id", F.lower("text").alias("text")), "asked")
    different = asked.groupBy("text").agg(F.min("query_id").alias("first"))
    same = asked.join(different, "text").select("query_id", "first")
    passes, parts = max(1, -(-different.count() // block)), []
    for i in range(passes):
        own = different if passes == 1 else different.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == i)
        lines = []
        for r in own.collect():  # a block
            g, times = grams(r.text)
            at = np.minimum(np.searchsorted(known, g), max(0, len(known) - 1))
            there = np.flatnonzero(known[at] == g) if len(known) else np.zeros(0, dtype=np.int64)
            if len(there):
                w = times[there] * idf[at[there]]
                lines.append((r.first, g[there], w / np.sqrt(w @ w)))
        if lines:
            parts.append(texts.mapInArrow(_score(spark.sparkContext.broadcast(Asked(lines)), vocabulary, k, least), "first long, id long, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    found = ws.save(reduce(DataFrame.union, parts).where((F.col("score") > 0) & (F.col("score") >= least)), "found")
    best = top_k(found, ["first"], "score", "id", k)
    return best.join(same, "first").select("query_id", "id", "score", "rank")


def _by_joins(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    posts = postings(docs, char_grams(F.col("text"), LOW, HIGH))
    n = docs.where("id IS NOT NULL").count()
    df = posts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).select("term", "idf")
    weights = posts.join(df, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = postings(queries.withColumnRenamed("query_id", "id"), char_grams(F.col("text"), LOW, HIGH)).join(df, "term").select(F.col("id").alias("query_id"), "term", (F.col("tf") * F.col("idf")).alias("qw"))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dots = weights.join(q, "term").groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    scored = dots.join(norms, "id").join(qn, "query_id").select("query_id", "id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 6).alias("score"))
    return top_k(scored.where("score > 0"), ["query_id"], "score", "id", k)
