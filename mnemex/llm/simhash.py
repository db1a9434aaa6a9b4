"""SimHash near-duplicate groups by anchor-point covering.

Fingerprints that differ in at most 4 of 64 bits differ in at most 2 bits of the
low or of the high 32. On 31 bits of each half the codewords of the perfect
Hamming code [31, 26] are the anchors: covering radius 1, so any two points within
2 bits have a point half way, and an anchor within 1 of that, hence within
2 = radius + half the threshold of both. Every distinct fingerprint is replicated to all
anchors within that distance (16 at most a half) and compared per anchor only.

An anchor with more than ``bucket_rows`` fingerprints isn't compared pair by pair (a size switch). Its
fingerprints are replicated to all 2,081 points within 2 bits (the covering
code of radius 0; for smaller limits, to those within half of it): two are within 4 bits if and only if they share such a point, so
linking each to the first at its points is exact and linear in their number.

Defined results: null and word-less texts have fingerprint 0 and link like any
other; equal rows are rows of their own in one group; null ids take part and count last;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..shared import Workspace, within

SHINGLE_WORDS = 4
SEED = 42
HALF = 31
LOW = np.uint64((1 << HALF) - 1)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the whole text; A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(width)))), len(words) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 15):
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), dtype="<u8", count=batch.num_rows)
        yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(marks.view("<i8"))})


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the words of weight 2 or less with it; and how many there are."""
    masks, counts = np.zeros((32, 16), dtype=np.uint64), np.zeros(32, dtype=np.int64)
    words = [((), 0)] + [((i,), i) for i in range(1, 32)] + [((i, j), i ^ j) for i, j in combinations(range(1, 32), 2)]
    for places, syndrome in words:
        masks[syndrome, counts[syndrome]] = sum(1 << (p - 1) for p in places)
        counts[syndrome] += 1
    return masks, counts


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor keys of the fingerprints, with the row each belongs to."""
    masks, counts = _masks()
    keys, rows = [], []
    for half in (0, 1):
        x = (fps >> np.uint64(32 * half)) & LOW
        syndrome = np.zeros(len(x), dtype=np.int64)
        for p in range(HALF):
            syndrome ^= ((x >> np.uint64(p)) & np.uint64(1)).astype(np.int64) * (p + 1)
        valid = np.arange(16)[None, :] < counts[syndrome][:, None]
        near = (x[:, None] ^ masks[syndrome]) | np.uint64(half << HALF)
        keys.append(near[valid])
        rows.append(np.nonzero(valid)[0])
    return np.concatenate(keys), np.concatenate(rows)


def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        keys, rows = anchors(fps.view("<u8"))
        yield pa.record_batch({"key": pa.array(keys.astype("<i8")), "fp": pa.array(fps[rows])})


def surround(limit: int):
    """Points around each fingerprint: within half the limit (side 0) and, if it is odd, one bit further (side 1). Two fingerprints are within
    the limit if and only if some point is near both and on side 0 for one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = range(limit // 2 + 1 + limit % 2)
        flips = [(w, sum(1 << b for b in bits)) for w in weights for bits in combinations(range(64), w)]
        side = np.array([w > limit // 2 for w, _ in flips], dtype=np.int32)
        flips = np.array([x for _, x in flips], dtype="<u8")
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for i in range(0, len(fps), 256):
                part = fps[i : i + 256]
                points = (part.view("<u8")[:, None] ^ flips).ravel()
                yield pa.record_batch({"key": pa.array(points.view("<i8")), "side": pa.array(np.tile(side, len(part))), "fp": pa.array(np.repeat(part, len(flips)))})

    return run


def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and side: links each to the first of its key if that is on side 0."""
    key = first = side = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, s, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        heads, sides = f[starts].copy(), s[starts].copy()
        if key is not None and k[0] == key:
            heads[0], sides[0] = first, side
        sizes = np.diff(np.r_[starts, len(k)])
        lead, ok = np.repeat(heads, sizes), np.repeat(sides == 0, sizes)
        key, first, side = k[-1], heads[-1], sides[-1]
        links = np.unique(np.stack([f, lead])[:, (f != lead) & ok], axis=1)
        yield pa.record_batch({"src": pa.array(links[0]), "dst": pa.array(links[1])})


def _near(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of one anchor as all pairs within the limit do."""
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= limit
    root = np.arange(len(fps))
    while True:
        low = np.where(close, root[None, :], len(fps)).min(axis=1)
        low = low[low]
        if (low == root).all():
            break
        root = low
    other = root != np.arange(len(fps))
    return fps[other], fps[root[other]]


def compare(limit: int):
    """Compares the fingerprints of each anchor; rows come sorted by anchor."""

    def links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        a, b = [], []
        for m in np.unique(sizes[sizes > 1]):
            at = starts[sizes == m]
            if m <= 6:
                for i, j in combinations(range(m), 2):
                    x, y = fps[at + i], fps[at + j]
                    ok = np.bitwise_count(x ^ y) <= limit
                    a.append(x[ok]), b.append(y[ok])
            else:
                for s in at:
                    x, y = _near(fps[s : s + m], limit)
                    a.append(x), b.append(y)
        none = np.zeros(0, dtype="<u8")
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, dtype="<i8"), np.zeros(0, dtype="<u8")

        def out(x, y):
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1).astype("<u8")
            return pa.record_batch({"src": pa.array(pairs[0].view("<i8")), "dst": pa.array(pairs[1].view("<i8"))})

        for batch in batches:
            k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            keys, fps = np.r_[keys, k], np.r_[fps, f.view("<u8")]
            if len(keys):
                done = int(np.searchsorted(keys, keys[-1]))
                yield out(*links(keys[:done], fps[:done]))
                keys, fps = keys[done:], fps[done:]
        if len(keys):
            yield out(*links(keys, fps))

    return run


def near_links(fps: DataFrame, ws: Workspace, limit: int = 4, bucket_rows: int = 2000, crowds: bool = True) -> DataFrame:
    """``(src, dst)`` between distinct fingerprints (column ``fp``): the same groups as all pairs within ``limit`` bits, at most 4. Without ``crowds`` the fingerprints of crowded anchors are left to other anchors: for those who have another way to find them."""
    if not 0 <= limit <= 4:
        raise ValueError("the anchors cover up to 4 differing bits")
    covered = fps.mapInArrow(replicate, "key long, fp long")
    hot = ws.save(covered.groupBy("key").count().where(F.col("count") > bucket_rows).select("key"), "hot-anchors")
    cold, extra = covered, None
    if not within(hot, 0):
        small = F.broadcast(hot) if within(hot, 100_000) else hot
        cold = covered.join(small, "key", "left_anti")
    if cold is not covered and crowds:
        crowd = ws.save(covered.join(small, "key", "left_semi").select("fp").distinct(), "crowded")
        points = crowd.mapInArrow(surround(limit), "key long, side int, fp long")
        extra = points.repartition("key").sortWithinPartitions("key", "side", "fp").mapInArrow(star, "src long, dst long")
    found = cold.repartition("key").sortWithinPartitions("key").mapInArrow(compare(limit), "src long, dst long")
    return (found if extra is None else found.union(extra)).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4, bucket_rows: int = 2000) -> DataFrame:
    """``doc_id, fp, component_id``: one row per input row; the smallest id that links of at most ``limit`` bits reach."""
    ws = Workspace(docs.sparkSession, "simhash")
    kind = docs.schema[id_col].dataType.simpleString()
    marks = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(fingerprints, f"doc_id {kind}, fp long")
    marks = ws.save(marks, "fingerprints")
    groups = ws.save(marks.groupBy("fp").agg(F.min("doc_id").alias("low")), "groups")
    comps = ws.save(connected_components(near_links(groups.select("fp"), ws, limit, bucket_rows)), "components")
    rooted = groups.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lows = ws.save(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    classes = ws.save(rooted.join(lows, "root").select("fp", "component_id"), "classes")
    return marks.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the smallest id. Near are texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more; fingerprints and sketches propose them (``near_copies``).

    Rows without an id can't be told apart and are kept. If one id has several texts, they are documents of their own; of rows that agree in id and text the one that is
    smallest in its other columns, from left to right, stays.
    """
    from .near_copies import near_copies

    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"))
    known = docs.where(F.col(id_col).isNotNull())
    ws = Workspace(docs.sparkSession, "near-dedup")
    found = near_copies(known.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", ws)
    kept_keys = found.where("key = component").select("key.id", "key.hash")
    heads = Workspace(docs.sparkSession, "near-dedup-heads").save(kept_keys, "heads")
    ws.drop("")  # nothing else is needed
    kept = known.join(heads.distinct(), (known[id_col] == heads["id"]) & (F.xxhash64(known[text_col]) == heads["hash"]), "left_semi")
    if not within(heads.groupBy("id", "hash").count().where("count > 1"), 0):
        first = kept.groupBy(id_col, text_col).agg(F.min(F.struct(*kept.columns)).alias("_row"))
        kept = first.select("_row.*")
    return kept.union(docs.where(F.col(id_col).isNull()))


def op6(docs: DataFrame) -> DataFrame:
    found = simhash_groups(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
