"""Hard negatives of each anchor and positive, by product quantisation with stored residual norms.

Vectors are whole numbers. They are cut in parts of four components; each part is replaced by the nearest of up to 256 centres, and the length of what is left over is
stored with the code, rounded up. An anchor's product with a vector then lies within the looked-up products of the centres plus or minus the sum over parts of
(length of the anchor's part) x (length of the left-over): a bound that always holds. The centres are fitted on a bounded sample (``sample_rows``); every row is encoded, and bounds
hold for rows that no centre is near, so results are exact whatever the sample.

A block of anchors goes to all tasks. For each window of an anchor (label, lowest and highest score) a batch of rows is filtered by upper and lower bound; what is left is
ranked by upper bound and reranked by exact integer products, until the next upper bound is below the k-th exact score. That score carries over to later batches of the task. Only the k best of a window leave a
task, so no pair is ever a row; a second ranking joins the tasks. First the positives of each anchor are searched like that, then the windows that they open.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; vectors meet only vectors of their own length; rows that repeat an id are rows of their own, but no
positive or negative of an anchor with that id, and of anchors that repeat an id the smallest label, then vector, counts; ties go to smaller ids; other columns are ignored. Components of 2**24 and more are refused, since
their products may pass 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_k
from ..shared import Workspace

PART, CENTRES, ROUNDS = 4, 256, 8
SAMPLE_ROWS = 4096
BLOCK = 1024  # anchors sent to all tasks at a time
STEP = 4096  # rows looked at together
LARGEST = 1 << 24
_FOUND = "anchor_id long, slot int, id long, score long"


def _parts(x: np.ndarray) -> np.ndarray:
    """(rows, parts, components), the last part filled with zeros."""
    lack = -x.shape[1] % PART if x.shape[1] else PART
    return np.pad(x, ((0, 0), (0, lack))).reshape(len(x), -1, PART).astype(np.float64)


def _closest(own: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * own @ centres.T).argmin(axis=1)


def fit(sample: np.ndarray) -> np.ndarray:
    """Centres (part, number, component) by Lloyd's rounds, from rows spread over the sample; a centre that nothing is near stays."""
    parts = _parts(sample)
    books = []
    for s in range(parts.shape[1]):
        own = parts[:, s]
        distinct = np.unique(own, axis=0)
        centres = distinct[np.linspace(0, len(distinct) - 1, min(CENTRES, len(distinct))).astype(int)] if len(distinct) else np.zeros((1, PART))
        for _ in range(ROUNDS if len(own) else 0):
            near = _closest(own, centres)
            n = np.bincount(near, minlength=len(centres))
            total = np.stack([np.bincount(near, own[:, c], len(centres)) for c in range(PART)], axis=1)
            centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        books.append(np.pad(centres, ((0, CENTRES - len(centres)), (0, 0)), mode="edge"))
    return np.stack(books)


def encode(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and, rounded up, lengths of what is left of each part."""
    parts = _parts(vectors)
    codes = np.stack([_closest(parts[:, s], books[s]) for s in range(len(books))], axis=1).astype(np.uint8)
    rest = np.sqrt(((parts - books[np.arange(len(books)), codes]) ** 2).sum(axis=2))
    return codes, np.nextafter((rest * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def bounds(anchors: np.ndarray, codes: np.ndarray, rest: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """No product of an anchor (line) and a row (column) lies outside of these."""
    parts = _parts(anchors)
    near = np.zeros((len(anchors), len(codes)))
    for s, book in enumerate(books):
        near += (parts[:, s] @ book.T)[:, codes[:, s]]
    length = np.sqrt((parts**2).sum(axis=2))
    far = length @ rest.astype(np.float64).T
    slack = 1e-9 * (length.sum(axis=1)[:, None] * (1 + np.abs(books).max()) + far) + 1e-6  # of the arithmetic
    return near - far - slack, near + far + slack


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def _index(size: int, books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, rest = encode(_vectors(batch.column(2), size), books)
            yield pa.record_batch({"id": batch.column(0), "label": batch.column(1), "vector": batch.column(2), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "rest": pa.array([r.astype("<f4").tobytes() for r in rest], pa.binary())})

    return run


class Windows:
    """The k best rows of each window so far: those of the anchor's label, or not, with a score between two bounds."""

    def __init__(self, anchor: np.ndarray, slot: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.anchor, self.slot, self.low, self.high, self.same, self.k = anchor, slot, low, high, same, k

    def search(self, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, books: np.ndarray, size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = np.zeros(0, dtype=np.int64)
            best = [(none, none)] * len(self.anchor)
            least = self.low.astype(np.float64)
            for batch in batches:
                for at in range(0, batch.num_rows, STEP):
                    part = batch.slice(at, STEP)
                    row_ids, row_labels = (part.column(i).to_numpy() for i in (0, 1))
                    vectors = _vectors(part.column(2), size)
                    codes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(len(row_ids), -1)
                    rest = np.frombuffer(b"".join(part.column(4).to_pylist()), "<f4").reshape(len(row_ids), -1)
                    lower, upper = bounds(anchors, codes, rest, books)
                    for w, a in enumerate(self.anchor.tolist()):
                        there = np.flatnonzero((upper[a] >= least[w]) & (lower[a] <= self.high[w]) & ((row_labels == labels[a]) == self.same) & (row_ids != ids[a]))
                        if len(there):
                            best[w], least[w] = self._rerank(best[w], least[w], w, there[np.argsort(-upper[a][there])], upper[a], row_ids, vectors, anchors[a])
            n = [len(x) for x, _ in best]
            out = [np.concatenate([none, *c]) for c in zip(*best, strict=True)] if best else [none, none]
            yield pa.record_batch({"anchor_id": pa.array(np.repeat(ids[self.anchor], n)), "slot": pa.array(np.repeat(self.slot, n).astype(np.int32)), "id": pa.array(out[1]), "score": pa.array(out[0])})

        return run

    def _rerank(self, best, least, w, there, upper, row_ids, vectors, anchor):
        """``there`` comes by upper bound, greatest first; those that can't be among the best are never multiplied."""
        at, step = 0, 4 * self.k
        while at < len(there) and upper[there[at]] >= least:
            own = there[at : at + step]
            score = vectors[own] @ anchor
            fits = (score >= self.low[w]) & (score <= self.high[w])
            s, i = np.r_[best[0], score[fits]], np.r_[best[1], row_ids[own][fits]]
            order = np.lexsort((i, -s))[: self.k]
            best = s[order], i[order]
            if len(order) == self.k:
                least = max(least, float(best[0][-1]))
            at, step = at + step, 2 * step
        return best, least


def _block(index: DataFrame, own: DataFrame, books: np.ndarray, size: int, positives: int, negatives: int, low: int, high: int, ws: Workspace, name: str) -> DataFrame | None:
    got = sorted((r.id, r.least.label, r.least.vector) for r in own.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("least")).collect())  # a block
    if not got:
        return None
    ids, labels = (np.array([r[c] for r in got], dtype=np.int64) for c in (0, 1))
    anchors = np.array([r[2] for r in got], dtype=np.int64).reshape(len(got), size)
    far = np.full(len(ids), LARGEST**2 * max(1, size), dtype=np.int64)
    every = Windows(np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64), -far, far, True, positives)
    rows = index.select("id", "label", "vector", "codes", "rest")
    near = top_k(rows.mapInArrow(every.search(ids, labels, anchors, books, size), _FOUND), ["anchor_id"], "score", "id", positives).select("anchor_id", "id", "score", F.col("rank").alias("slot"))
    near = ws.save(near, f"positives-{name}")
    opened = sorted((r.anchor_id, r.slot, -(-low * r.score // 100), high * r.score // 100) for r in near.collect())  # a block's
    opened = [x for x in opened if x[2] <= x[3]]
    anchor, slot, least, most = np.array(opened, dtype=np.int64).reshape(-1, 4).T
    windows = Windows(np.searchsorted(ids, anchor), slot, least, most, False, negatives)
    found = top_k(rows.mapInArrow(windows.search(ids, labels, anchors, books, size), _FOUND), ["anchor_id", "slot"], "score", "id", negatives)
    out = found.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(near.withColumnRenamed("id", "positive_id").withColumnRenamed("score", "positive_score"), ["anchor_id", "slot"])
    return ws.save(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), f"negatives-{name}")


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, sample_rows: int = SAMPLE_ROWS, block: int = BLOCK
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: of each anchor (``anchors`` says which ids are some, as a condition on ``id``) and each of its best rows of the same
    label, the best rows of other labels that score between ``low`` and ``high`` percent of the positive. Components are scaled and rounded down to whole numbers."""
    spark = rows.sparkSession
    ws = Workspace(spark, "hard-negatives")
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(vector_col, lambda x: x.cast("double")).alias("x"))
    usable = F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # nan is greater
    whole = F.transform("x", lambda x: F.when(F.abs(x) * scale < LARGEST, F.floor(scale * x)).otherwise(F.raise_error(F.lit("components this large are not supported"))))
    ints = ws.save(clean.where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(usable).select("id", "label", whole.cast("array<bigint>").alias("vector")), "vectors")
    out = []
    for size in sorted(r[0] for r in ints.select(F.size("vector")).distinct().collect()):  # lengths
        own = ints.where(F.size("vector") == size)
        sample = own.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").collect()  # a bounded sample
        books = fit(np.array([r.vector for r in sample], dtype=np.int64).reshape(len(sample), size))
        index = ws.save(own.mapInArrow(_index(size, books), "id long, label long, vector array<bigint>, codes binary, rest binary"), f"index-{size}")
        asked = index.where(anchors)
        passes = max(1, -(-asked.select("id").distinct().count() // block))
        for i in range(passes):
            part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i)
            out.append(_block(index, part, books, size, positives, negatives, low, high, ws, f"{size}-{i}"))
    out = [x for x in out if x is not None]
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.union, out)


def op12(rows: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
