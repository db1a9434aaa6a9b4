"""Maximal periodic runs of words, from longest previous factors and Lempel-Ziv blocks.

A run is a stretch of words with smallest period ``q``, at least ``exponent`` times as long as that and ``least`` words long, that no neighbouring word extends.

1. Suffixes of many texts are ranked together by doubling; a word of one text never equals one of another. The rank tables of all
   doublings stay, so the longest common extension of any two places, to the right or to the left, takes one look at each table. Suffix array and LCP follow from the last.
2. The longest previous factor of a place is its common prefix with the next smaller place above or below it in the suffix array, found by jumps over larger
   places. Blocks of the Lempel-Ziv factorisation are read off it.
3. Main: a run that isn't inside one block touches a block's start ``b`` where, of the blocks around it with ``x`` and ``y`` words, a period is at most
   (x + y - 1) / (exponent - 1): a longer one would have made the block before it longer. Each (start, period) is extended to both sides of the start; there
   are no more of them than words. Of equal stretches the smallest period stands.
4. A run strictly inside a block is copied from the block's earlier occurrence. Runs lie in buckets by their start, which are copied from left to right, so what is copied may be copied again.

One map, no shuffle: a task holds ``WORDS`` words, or one longer text, times the doublings its longest repeat takes. Defined results: null, empty and word-less texts have no
run and collapse to the empty text; equal rows are judged each; null ids pass; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPONENT, LEAST = 4, 6
WORDS = 1 << 17  # ranked together
Run = tuple[int, int, int]


def rank_tables(symbols: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """Table k ranks the places by the 2**k symbols from them on (fewer where their text stops, at ``stops``); equal ranks mean equal stretches. In the last no two are equal.
    A last entry stands for the place behind all texts."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][:n])
    sizes = np.diff(np.r_[heads, n])
    rank = np.full(n + 1, -1, dtype=np.int64)
    rank[order] = np.repeat(heads, sizes)
    tables, step = [rank], 1
    open_ = order[np.repeat(sizes, sizes) > 1]
    while len(open_):
        after = open_ + step
        key = rank[open_] * (n + 1) + np.where(after < stops[open_], rank[np.minimum(after, n)] + 1, 0)
        by = np.argsort(key, kind="stable")
        key, open_ = key[by], open_[by]
        old = rank[open_]
        at = np.arange(len(key))
        new_old = np.r_[True, old[1:] != old[:-1]]
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        sizes = np.diff(np.r_[first, len(key)])
        rank = rank.copy()
        rank[open_] = old + np.repeat(first, sizes) - np.maximum.accumulate(np.where(new_old, at, 0))
        tables.append(rank)
        open_ = open_[np.repeat(sizes, sizes) > 1]
        step *= 2
    return tables


def common(tables: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words that the texts from the different places ``x`` and ``y`` on have in common."""
    n, out = len(tables[0]) - 1, np.zeros(len(x), dtype=np.int64)
    for k in range(len(tables) - 1, -1, -1):
        out += (tables[k][np.minimum(x + out, n)] == tables[k][np.minimum(y + out, n)]).astype(np.int64) << k
    return out


def common_before(tables: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words in common to the left, ``x`` and ``y`` included; one of them may be -1."""
    out = np.zeros(len(x), dtype=np.int64)
    for k in range(len(tables) - 1, -1, -1):
        a, b = x - out - (1 << k) + 1, y - out - (1 << k) + 1
        ok = (a >= 0) & (b >= 0)
        out += (ok & (tables[k][np.maximum(a, 0)] == tables[k][np.maximum(b, 0)])).astype(np.int64) << k
    return out


def previous_factors(tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest stretch from it on that also starts earlier in its text, and where."""
    n = len(tables[0]) - 1
    order = np.empty(n, dtype=np.int64)
    order[tables[-1][:n]] = np.arange(n)
    lcp = np.zeros(n + 1, dtype=np.int64)  # with the suffix above
    alike = np.flatnonzero(tables[0][order[1:]] == tables[0][order[:-1]]) + 1
    lcp[alike] = common(tables, order[alike - 1], order[alike])
    length, source = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    for side in (-1, 1):
        near = np.arange(n) + side
        shared = lcp[:n].copy() if side < 0 else lcp[1:].copy()
        open_ = np.flatnonzero(shared > 0)
        while len(open_):
            to = near[open_]
            open_, to = (z[(shared[open_] > 0) & (order[to] > order[open_])] for z in (open_, to))
            far, less = near[to], np.minimum(shared[open_], shared[to])
            near[open_], shared[open_] = far, less
            open_ = open_[less > 0]
        more = np.flatnonzero(shared > length[order])
        length[order[more]], source[order[more]] = shared[more], order[near[more]]
    return length, source


def blocks(length: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the Lempel-Ziv blocks of all texts, and of the first block of each text its number."""
    to = (np.arange(len(length)) + np.maximum(length, 1)).tolist()
    out, firsts = [], []
    for at, stop in zip(starts.tolist(), stops.tolist(), strict=True):
        firsts.append(len(out))
        while at < stop:
            out.append(at)
            at = to[at]
    return np.array(out, dtype=np.int64), np.array(firsts, dtype=np.int64)


def touching(tables: list[np.ndarray], lz: np.ndarray, text_of: np.ndarray, starts: np.ndarray, stops: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """(first word, word after the last, period) of all runs that touch the start of a block or the end of a text, by start."""
    size = np.diff(np.r_[lz, stops[-1]])
    inner = np.flatnonzero(lz > starts[text_of[lz]])  # a start with a block of its text before it
    last = np.searchsorted(lz, stops[stops > starts], "left") - 1  # the last block of each text, whose end counts too
    at = np.r_[lz[inner], stops[stops > starts]]
    most = np.r_[(size[inner - 1] + size[inner] - 1) // (exponent - 1), size[last] // exponent]
    text = np.r_[text_of[lz[inner]], text_of[lz[last]]]
    b = np.repeat(at, most)
    p = np.arange(len(b)) - np.repeat(np.cumsum(most) - most, most) + 1
    low, high = np.repeat(starts[text], most), np.repeat(stops[text], most)
    none = np.zeros(0, dtype=np.int64)
    found = [(none, none, none)]
    for x in (b, b - p):  # a period's worth of words lies right of the start, or left of it
        y = x + p
        ok = (x >= low) & (y < high) if x is b else x >= low
        bb, pp, x, y, lo, hi = (z[ok] for z in (b, p, x, y, low, high))
        n = len(tables[0]) - 1
        right = (y < hi) & (tables[0][x] == tables[0][np.minimum(y, n)])
        left = (x > lo) & (tables[0][x - 1] == tables[0][y - 1])
        ok = right | left
        bb, pp, x, y, right, left = (z[ok] for z in (bb, pp, x, y, right, left))
        ahead, behind = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        ahead[right] = common(tables, x[right], y[right])
        behind[left] = common_before(tables, x[left] - 1, y[left] - 1)
        ok = pp + ahead + behind >= np.maximum(exponent * pp, least)
        found.append(((x - behind)[ok], (y + ahead)[ok], pp[ok]))
    a, z, p = (np.concatenate(c) for c in zip(*found, strict=True))
    by = np.lexsort((p, z, a))
    a, z, p = a[by], z[by], p[by]
    new = np.r_[True, (a[1:] != a[:-1]) | (z[1:] != z[:-1])][: len(a)]
    return np.stack([a[new], z[new], p[new]], axis=1)


def copied(runs: list[Run], lz: list[int], stop: int, length: np.ndarray, source: np.ndarray, least: int) -> list[Run]:
    """``runs`` of one text with those strictly inside its blocks, which the blocks' earlier occurrences have too."""
    by_start: dict[int, list[tuple[int, int]]] = {}
    for a, z, p in runs:
        by_start.setdefault(a, []).append((z, p))
    for s in lz:
        n = int(length[s])
        if n < least + 2:
            continue
        from_, shift = int(source[s]), s - int(source[s])
        for a in range(from_ + 1, from_ + n - least):
            for z, p in by_start.get(a, ()):
                if z < from_ + n:
                    by_start.setdefault(a + shift, []).append((z + shift, p))
    return sorted((a, z, p) for a, own in by_start.items() for z, p in own)


def runs_of(texts: list[list[bytes]], exponent: int = EXPONENT, least: int = LEAST) -> list[list[Run]]:
    """Runs of each list of words: (start, length, period), by start, then period."""
    if exponent < 2:
        raise ValueError("a run repeats its period once at least")
    codes, base = [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        codes.append(np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words)) + base)
        base += len(known)
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    if not sizes.sum():
        return [[] for _ in texts]
    text_of = np.repeat(np.arange(len(texts)), sizes)
    tables = rank_tables(np.concatenate(codes), stops[text_of])
    length, source = previous_factors(tables)
    lz, firsts = blocks(length, starts, stops)
    runs = touching(tables, lz, text_of, starts, stops, exponent, least)
    out: list[list[Run]] = [[] for _ in texts]
    own = text_of[runs[:, 0]]
    ends = np.r_[firsts, len(lz)]
    for part in np.split(np.arange(len(runs)), np.flatnonzero(np.diff(own)) + 1) if len(runs) else []:
        i = int(own[part[0]])
        found = copied([tuple(x) for x in runs[part].tolist()], lz[ends[i] : ends[i + 1]].tolist(), int(stops[i]), length, source, least)
        at = int(starts[i])
        out[i] = [(a - at, z - a, p) for a, z, p in sorted(found, key=lambda x: (x[0], x[2]))]
    return out


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]


Words = Callable[[object, list[bytes]], list[bytes]]


def _batches(batches: Iterator[pa.RecordBatch], words: Words | None) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids: list = []
    texts: list[list[bytes]] = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            own = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            key = key.as_py()
            ids.append(key), texts.append(words(key, own) if words else own)
            size += len(texts[-1])
            if size >= WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Words | None = None, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """``doc_id``, ``runs`` (start, length and period in words, by start, then period) and ``collapsed``: the words outside all runs' repeats, joined by a space.

    ``words`` may change the words of a text before they are looked at."""
    kind = docs.schema[id_col].dataType
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches, words):
            found = runs_of(texts, exponent, least)
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in found]
            kept = [b" ".join(collapse(t, own)).decode("utf-8", "surrogatepass") for t, own in zip(texts, found, strict=True)]
            yield pa.record_batch({"doc_id": pa.array(ids), "runs": pa.array(rows, run_type), "collapsed": pa.array(kept, pa.string())})

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(key: object, words: list[bytes]) -> list[bytes]:
    """The words of a text, of every tenth one with a tail that repeats; texts without an id stay."""
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11(docs: DataFrame) -> DataFrame:
    found = periodic_runs(docs, words=planted)
    first = lambda of: F.transform("runs", of)
    best = F.array_max(first(lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", first(lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * best.length) DIV (-best.period)").cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
