"""Exact nearest neighbours of a stated set of queries against all rows, in blocks.

A block of query vectors is sent to all tasks; each batch of rows is multiplied with it and
only the k best of each query, by rounded score and id, leave the batch. No pair is ever a row. More queries than a block
takes mean more passes, so what is sent never grows. Queries meet only vectors of their own length; null vectors, ids and
components take no part. For all rows as queries there is ``vector_index``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_k

BLOCK = 8192
SCALE = 1e6  # scores have six digits


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of this length, and the vectors."""
    at = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size)
    flat = column.take(pa.array(at)).flatten()
    return at, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)


def _rounded(score: np.ndarray) -> np.ndarray:
    """To six digits, halves away from zero as in Spark; ranks are taken on these."""
    return np.copysign(np.floor(np.abs(score) * SCALE + 0.5) / SCALE, score)


def best_of(score: np.ndarray, rows: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each line of scores the ids of its k best rows by rounded score, the smaller id on a tie, and the rounded scores; -inf never counts."""
    n = min(k, len(rows))
    least = np.partition(score, len(rows) - n, axis=1)[:, len(rows) - n] - 2 / SCALE  # no score below rounds to the n-th best
    kept, found = [], []
    for own, low in zip(score, least, strict=True):
        at = np.flatnonzero((own >= low) & np.isfinite(own))
        value = _rounded(own[at])
        best = np.lexsort((rows[at], -value))[:n]
        kept.append(rows[at[best]])
        found.append(value[best])
    return kept, found


def _nearest(ids: np.ndarray, queries: np.ndarray, k: int, metric: str, itself: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            at, x = _matrix(batch.column(1), queries.shape[1])
            if not len(at):
                continue
            rows = batch.column(0).to_numpy()[at]
            if metric == "cosine":
                score = queries @ x.T / np.maximum(np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :], 1e-12)
            else:
                score = -((queries**2).sum(1)[:, None] - 2 * queries @ x.T + (x**2).sum(1)[None, :])
            if not itself:
                score = np.where(ids[:, None] == rows[None, :], -np.inf, score)
            score[np.isnan(score)] = -np.inf
            kept, found = best_of(score, rows, k)
            yield pa.record_batch({"query_id": pa.array(np.repeat(ids, [len(x) for x in kept])), "id": pa.array(np.concatenate(kept)), "score": pa.array(np.concatenate(found))})

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, metric: str = "cosine", itself: bool = True, block: int = BLOCK) -> DataFrame:
    """``query_id, id, score, rank`` of (query_id, vector) against (id, vector): cosine, or minus the squared distance. Ties go to the smaller id."""
    n = queries.count()
    passes = max(1, -(-n // block))
    parts = []
    for i in range(passes):
        own = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
        got = own.select("query_id", "vector").where("query_id IS NOT NULL AND vector IS NOT NULL").where(~F.exists("vector", lambda x: x.isNull())).collect()  # a block
        for size in sorted({len(r.vector) for r in got}):
            same = [r for r in got if len(r.vector) == size]
            ids, q = np.array([r.query_id for r in same], dtype=np.int64), np.array([r.vector for r in same], dtype=np.float64).reshape(-1, size)
            parts.append(rows.select("id", "vector").mapInArrow(_nearest(ids, q, k, metric, itself), "query_id long, id long, score double"))
    if not parts:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    return top_k(reduce(DataFrame.union, parts).withColumn("score", F.round("score", 6)), ["query_id"], "score", "id", k)
