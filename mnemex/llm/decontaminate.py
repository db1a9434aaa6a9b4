"""Benchmark passages in training texts, by spaced seeds.

Words are lower-cased and stripped to letters and digits. A seed is a fixed mask over consecutive words that ignores
some of them; the masks are chosen so that any 12 aligned words with at most 2
substituted hold all the words that one of them looks at; shorter items have masks of their own length. Hashes of benchmark and training text under the same mask
are joined as tables, and each hit is verified on its diagonal: the item is laid over the text and counts
where 12 words in a row have 10 or more in common. Items of 5 to 11 words count where 80 % of the
whole item agree.

A training text keeps, for the join, only hashes that a bit table of all benchmark hashes lets through; the table has
64 bits a hash and at most ``filter_bits``, so it never grows past that; a larger benchmark lets more through and the join still decides. Few texts have a hash left: those are
written with their words, everything after reads them alone. A hash travels once a text and once an item with all its places, so neither repeated words nor
a passage that a third of all documents share multiply rows; of many diagonals each is looked at once.

Defined results: null and empty texts and items never match; items under 5 words are not searched; one row for each pair of
(row of documents, item) with an overlap; repeated rows are reported each; null ids pass; an empty benchmark gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Workspace, within

WINDOW, ALIKE, SHORT = 12, 10, 5
WEIGHT = 6
FILTER_BITS = 1 << 27
BROADCAST_BYTES = 64 << 20
BROADCAST_TEXTS = 1_000_000
PART = 1 << 20
NOT_WORD = re.compile(r"[\W_]+")
CACHE = 150_000


def masks(window: int = WINDOW, wrong: int = WINDOW - ALIKE, weight: int = WEIGHT) -> list[tuple[int, ...]]:
    """Greedy: masks of ``weight`` places so that any ``wrong`` substitutions in ``window`` words leave one of them whole at some shift."""
    left = set(combinations(range(window), wrong))
    shapes = [(0, *c) for span in range(weight, window + 1) for c in combinations(range(1, span), weight - 1) if c[-1] == span - 1]

    def solved(shape):
        found = set()
        for shift in range(window - shape[-1]):
            used = {p + shift for p in shape}
            found |= {x for x in left if not used & set(x)}
        return found

    chosen = []
    while left:
        best = max(shapes, key=lambda s: (len(solved(s)), -s[-1]))
        left -= solved(best)
        chosen.append(best)
    return chosen


def least_alike(n: int) -> int:
    """Words that must agree of ``n`` aligned ones."""
    return ALIKE if n >= WINDOW else ceil(0.8 * n)


#: What ``masks()`` gives, so that workers needn't search; a test holds one against the other.
MASKS: list[tuple[int, ...]] = [(0, 1, 2, 4, 6, 7), (0, 2, 3, 6, 7, 8), (0, 1, 2, 3, 4, 5)]
FACTORS = np.array([xxhash.xxh64_intdigest(f"place {i}") | 1 for i in range(WINDOW)], dtype=np.uint64)


@lru_cache(maxsize=16)
def masks_for(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks of an item of ``n`` words; none under ``SHORT``."""
    if n < SHORT:
        return ()
    return tuple(MASKS) if n >= WINDOW else tuple(masks(n, n - least_alike(n), 3 if n - least_alike(n) == 1 else 4))


class Words(dict):
    """Hash of a raw word; 0 if nothing but punctuation."""

    def __missing__(self, raw: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        bare = NOT_WORD.sub("", raw.lower())
        value = self[raw] = (xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass")) | 1) if bare else 0
        return value

    def of(self, text: str | None) -> np.ndarray:
        raw = (text or "").split()
        hashes = np.fromiter(map(self.__getitem__, raw), dtype=np.uint64, count=len(raw))
        return hashes[hashes != 0]


def seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(xxhash.xxh64_intdigest(repr(mask))))
    for k, p in enumerate(mask):
        out += words[p : p + n] * FACTORS[k]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(32))


def _by_hash(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes, how often each stands, and the places in that order."""
    order = np.lexsort((at, h))
    h, at = h[order], at[order]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    return h[start], np.diff(np.r_[start, len(h)]), at


PROBES = 8


def _bits(h: np.ndarray, size: int, probe: int) -> np.ndarray:
    """The bit of each hash, one for each of ``PROBES``; ``size`` is a power of two."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h + np.uint64(probe) * step) & np.uint64(size - 1)


def _table(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, dtype=bool)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view("<u8")
            for probe in range(PROBES):
                table[_bits(h, size, probe)] = True
        yield pa.record_batch({"bits": pa.array([np.packbits(table).tobytes()], pa.binary())})

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Words()
    for batch in batches:
        words = [known.of(x.as_py()) for x in batch.column(1)]
        yield pa.record_batch({"item_id": batch.column(0), "own": pa.array([w.tobytes() for w in words], pa.binary()), "n_own": pa.array([len(w) for w in words], pa.int32())})


_PLACES = "hash long, low int, high int, places binary"


def _places(h: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> dict[str, pa.Array]:
    ends = np.cumsum(sizes)
    raw = at.astype("<i4")
    return {
        "hash": pa.array(h.view("<i8"), pa.int64()), "low": pa.array(raw[ends - sizes], pa.int32()), "high": pa.array(raw[ends - 1], pa.int32()),
        "places": pa.array([raw[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary()),
    }


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = np.frombuffer(own, "<u8")
            found = [seeds(w, m) for m in masks_for(len(w))]
            if found:
                got = _places(*_by_hash(np.concatenate(found), np.concatenate([np.arange(len(x)) for x in found])))
                yield pa.record_batch({"item": pa.array([item] * len(got["hash"]), pa.int64()), **got})


def _candidates(bits: bytes, used: list[tuple[int, ...]]):
    """Texts with a hash that the bit table lets through: their words, the hashes and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = Words(), np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)

        def out(batch, held):
            flat = np.concatenate([w for _, w in held])
            ends = np.cumsum([len(w) for _, w in held])
            found, places, owners = [], [], []
            for mask in used:
                h = seeds(flat, mask)
                at = np.flatnonzero(table[_bits(h, len(table), 0)])
                for probe in range(1, PROBES):
                    at = at[table[_bits(h[at], len(table), probe)]]
                owner = np.searchsorted(ends, at, "right")
                inside = at + mask[-1] < ends[owner]
                found.append(h[at[inside]]), places.append(at[inside]), owners.append(owner[inside])
            h, at, owner = map(np.concatenate, (found, places, owners))
            order = np.argsort(owner, kind="stable")
            rows = []
            for part in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1) if len(order) else []:
                row, words = held[owner[part[0]]]
                start = int(ends[owner[part[0]]]) - len(words)
                own, sizes, place = _by_hash(h[part], at[part] - start)
                rows.append((row, words.tobytes(), own.tobytes(), sizes.astype("<i4").tobytes(), place.astype("<i4").tobytes()))
            if rows:
                index, *columns = zip(*rows, strict=True)
                taken = batch.take(pa.array(index, pa.int64()))
                names = ("words", "hashes", "sizes", "places")
                yield pa.record_batch([*taken.columns, *(pa.array(c, pa.binary()) for c in columns)], names=["doc_id", "text", *names]).drop_columns(["text"])

        for batch in batches:
            held, size = [], 0
            for row, x in enumerate(batch.column(1)):
                words = known.of(x.as_py())
                if len(words):
                    held.append((row, words))
                    size += len(words)
                if size >= PART:
                    yield from out(batch, held)
                    held, size = [], 0
            if held:
                yield from out(batch, held)

    return run


def _text_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rid, hashes, sizes, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got = _places(np.frombuffer(hashes, "<u8"), np.frombuffer(sizes, "<i4"), np.frombuffer(places, "<i4"))
            yield pa.record_batch({"rid": pa.array([rid] * len(got["hash"]), pa.int64()), **got})


def diagonals(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Different values of place - offset, ascending, over lists of places and offsets; memory is that of their span."""
    low = min(int(p.min() - o.max()) for p, o in pairs)
    high = max(int(p.max() - o.min()) for p, o in pairs)
    hit = np.zeros(high - low + 1, dtype=bool)
    for p, o in pairs:
        if len(p) < len(o):
            for x in p.tolist():
                hit[x - o - low] = True
        else:
            for x in o.tolist():
                hit[p - x - low] = True
    return low + np.flatnonzero(hit)


def verify(words: np.ndarray, own: np.ndarray, first: int) -> tuple[int, int, int] | None:
    """Start, words and matches of the overlap if the item's first word is laid on place ``first``."""
    lo, hi = max(0, -first), min(len(own), len(words) - first)
    need = min(WINDOW, len(own))
    if hi - lo < need:
        return None
    same = own[lo:hi] == words[first + lo : first + hi]
    total = np.r_[0, np.cumsum(same)]
    good = np.flatnonzero(total[need:] - total[:-need] >= least_alike(need))
    if not len(good):
        return None
    a, b = int(good[0]), int(good[-1]) + need
    return first + lo + a, b - a, int(total[b] - total[a])


def longest(words: np.ndarray, own: np.ndarray, firsts: np.ndarray) -> tuple[int, int, int] | None:
    """The longest overlap, the earliest of equal ones; diagonals come ascending, so one as long as the item ends the search."""
    best = None
    for first in firsts.tolist():
        got = verify(words, own, first)
        if got and (best is None or (got[1], -got[0]) > (best[1], -best[0])):
            best = got
            if got[1] == len(own):
                break
    return best


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for rid, item, base, words, own, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lists = [(np.frombuffer(p["places"], "<i4"), np.frombuffer(p["offsets"], "<i4")) for p in pairs]
            got = longest(np.frombuffer(words, "<u8"), np.frombuffer(own, "<u8"), diagonals(lists) - base)
            if got:
                rows.append((rid, item, got[0] + base, got[1], got[2]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["rid", "item", "start_word", "n_words", "n_same"])


def _overlaps(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, filter_bits: int) -> DataFrame | None:
    """``doc_id, item_id, start_word, n_words, n_same`` of rows (doc_id, text); None if there is nothing to look for."""
    ws = Workspace(rows.sparkSession, "decontamination")
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates()
    items = items.mapInArrow(_item_words, f"item_id {item_kind}, own binary, n_own int").where(F.col("n_own") >= SHORT)
    items = ws.save(items.withColumn("item", F.monotonically_increasing_id()), "items")
    lengths = [r.n for r in items.select(F.least("n_own", F.lit(WINDOW)).alias("n")).distinct().collect()]  # 8 at most
    if not lengths:
        return None
    tests = ws.save(items.select("item", "own").mapInArrow(_item_seeds, f"item long, {_PLACES}"), "seeds")
    n, offsets = tests.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("places")), F.lit(0))).first()
    size = min(filter_bits, 1 << max(16, (64 * n - 1).bit_length()))
    bits = np.zeros(size // 8, dtype=np.uint8)
    for r in tests.select("hash").coalesce(8).mapInArrow(_table(size), "bits binary").toLocalIterator():
        bits |= np.frombuffer(r.bits, np.uint8)
    used = sorted({m for x in lengths for m in masks_for(x)})
    texts = rows.mapInArrow(_candidates(bits.tobytes(), used), f"doc_id {kind}, words binary, hashes binary, sizes binary, places binary")
    texts = ws.save(texts.withColumn("rid", F.monotonically_increasing_id()), "texts")
    found = texts.select("rid", "hashes", "sizes", "places").mapInArrow(_text_seeds, f"rid long, {_PLACES}")
    other = tests.select("hash", "item", F.col("low").alias("o_low"), F.col("high").alias("o_high"), F.col("places").alias("offsets"))
    hits = found.join(F.broadcast(other) if 32 * n + offsets <= BROADCAST_BYTES else other, "hash")
    hits = hits.groupBy("rid", "item").agg(F.min(F.col("low") - F.col("o_high")).alias("a"), F.max(F.col("high") - F.col("o_low")).alias("b"), F.collect_list(F.struct("places", "offsets")).alias("pairs"))
    near = hits.join(items.select("item", "own", "n_own"), "item").join(texts.select("rid", "words"), "rid").withColumn("base", F.greatest("a", F.lit(0)))
    near = near.select("rid", "item", "base", F.expr("substring(words, 8 * base + 1, 8 * (b - base + n_own))").alias("words"), "own", "pairs")
    good = ws.save(near.mapInArrow(_verify, "rid long, item long, start_word long, n_words long, n_same long"), "overlaps")
    return good.join(items.select("item", "item_id"), "item").join(texts.select("rid", "doc_id"), "rid").select("doc_id", "item_id", "start_word", "n_words", "n_same")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, n_same``: the longest overlap of each pair that has one."""
    found = _overlaps(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, item_col, item_text, filter_bits)
    if found is None:
        item_kind = benchmark.schema[item_col].dataType
        none = docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast(item_kind).alias("item_id"), *(F.lit(0).cast("long").alias(c) for c in ("start_word", "n_words", "n_same")))
        return none.where("false")
    return found


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` without rows whose text overlaps an item. The verdict belongs to the text, so rows are found again by its digest."""
    digest = F.unhex(F.md5(F.col(text_col).cast("binary")))
    rows = docs.select(digest.alias("doc_id"), F.col(text_col).alias("text"))
    found = _overlaps(rows, benchmark, item_col, item_text, filter_bits)
    if found is None:
        return docs
    dirty = Workspace(docs.sparkSession, "decontamination").save(found.select(F.col("doc_id").alias("_dirty_text")).distinct(), "dirty")
    few = F.broadcast(dirty) if within(dirty, BROADCAST_TEXTS) else dirty
    return docs.join(few, digest == few["_dirty_text"], "left_anti")


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return overlaps(docs, benchmark)
