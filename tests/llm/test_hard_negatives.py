"""Hard negatives against all pairs; bounds that always hold."""

import random

import numpy as np

from pyspark.sql import functions as F

from mnemex.llm import hard_negatives


def plain(rows, positives=5, negatives=10):
    out = []
    whole = [(i, y, np.floor(256 * np.array(x, dtype=np.float64)).astype(np.int64)) for i, y, x in rows if None not in (i, y, x) and all(v is not None and np.isfinite(v) for v in x)]
    for i, y, x in whole:
        if i % 100:
            continue
        score = [(-int(x @ z), j, t) for j, t, z in whole if j != i and len(z) == len(x)]
        for ps, pj, _ in sorted(s for s in score if s[2] == y)[:positives]:
            fits = sorted(s for s in score if s[2] != y and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:negatives]
            out += [(i, pj, k, j, -ps, -s) for k, (s, j, _) in enumerate(fits, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, y, x, "a", 1, 2) for i, y, x in rows], "vec_id long, label int, embedding array<float>, codes string, id int, score int").repartition(5)


def mined(df, **options):
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("id") % 100 == 0, **options).collect()))


def vectors(seed, n, size=10):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        x = [float(np.float32(v + r.gauss(0, 0.4))) for v in c]
        rows.append((i, r.randrange(4), x))
    return rows


def test_bounds_always_hold():
    r = np.random.default_rng(2)
    for size in (1, 3, 4, 10, 64):
        x = r.integers(-3000, 3000, (300, size)) // r.integers(1, 900, (300, 1))
        books = hard_negatives.fit(x[:40])
        codes, rest = hard_negatives.encode(x, books)
        low, high = hard_negatives.bounds(x[:50], codes, rest, books)
        exact = x[:50] @ x.T
        assert ((low <= exact) & (exact <= high)).all()


def test_against_all_pairs(spark, monkeypatch):
    rows = vectors(1, 900) + [(1000 + i, i % 3, [0.5] * 10) for i in range(120)] + [(2000 + 50 * i, 1, [0.0] * 10) for i in range(4)]
    rows += [(3000, 1, None), (3100, None, [1.0] * 10), (3200, 1, [1.0] * 9 + [None]), (3300, 1, [float("nan")] + [1.0] * 9), (3400, 2, [float("inf")] + [1.0] * 9), (None, 1, [1.0] * 10)]
    rows += [(4000, 1, [1.0, 2.0]), (4001, 1, [2.0, 2.0]), (4002, 2, [1.0, 1.0]), (4100, 3, [-1.0, -1.0]), (4200, 1, []), (4201, 1, []), (4202, 2, [])]
    want = plain(rows)
    assert len({x[:2] for x in want}) > 40
    df = frame(spark, rows)
    assert mined(df) == want
    assert mined(df, block=4, sample_rows=3) == want  # bad centres cost time only
    monkeypatch.setattr(hard_negatives, "STEP", 7)
    assert mined(df, positives=2, negatives=3) == plain(rows, 2, 3)
    assert mined(df.where("false")) == [] and mined(df.where("vec_id % 100 <> 0")) == []


def test_rows_that_repeat(spark):
    rows = [(0, 1, [1.0, 1.0]), (0, 1, [1.0, 1.0]), (0, 2, [9.0, 9.0]), (1, 1, [1.0, 0.9]), (1, 1, [1.0, 0.9]), (2, 2, [0.5, 0.5]), (2, 2, [0.5, 0.5]), (3, 2, [0.5, 0.5])]
    got = mined(frame(spark, rows))
    one = [(0, 1, k, j, 256 * 256 + 256 * 230, 128 * 256 * 2) for k, j in ((1, 2), (2, 2), (3, 3))]
    assert got == sorted(one + one)


def test_few_rows_are_multiplied(spark, sf, monkeypatch):
    """Candidates are those that bounds can't settle: a small part of all pairs."""
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = np.floor(256 * np.array([r[2] for r in rows], dtype=np.float64)).astype(np.int64)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.int64)
    at = np.flatnonzero(ids % 100 == 0)
    books = hard_negatives.fit(x)
    codes, rest = hard_negatives.encode(x, books)
    seen = []
    plain_rerank = hard_negatives.Windows._rerank

    def counted(self, best, least, w, there, upper, row_ids, vectors, anchor):
        class Counting(np.ndarray):
            def __matmul__(self, other):
                seen.append(len(self))
                return np.asarray(self) @ other

        return plain_rerank(self, best, least, w, there, upper, row_ids, vectors.view(Counting), anchor)

    monkeypatch.setattr(hard_negatives.Windows, "_rerank", counted)
    import pyarrow as pa

    batch = pa.record_batch({"id": pa.array(ids), "label": pa.array(labels), "vector": pa.array(x.tolist()), "codes": pa.array([c.tobytes() for c in codes]), "rest": pa.array([c.tobytes() for c in rest])})
    n = len(at)
    w = hard_negatives.Windows(np.arange(n), np.zeros(n, dtype=np.int64), np.full(n, -(10**9)), np.full(n, 10**9), True, 5)
    list(w.search(ids[at], labels[at], x[at], books, x.shape[1])(iter([batch])))
    assert sum(seen) < 0.5 * n * len(ids) * 0.1 + 20 * n
