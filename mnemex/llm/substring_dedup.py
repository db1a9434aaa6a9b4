"""Repeated 50-byte strings across documents, by merged Burrows-Wheeler transforms.

Sorting all suffixes of a corpus in one place isn't possible, so texts first find out what they may share.

1. Equal texts become one, with the smallest id. Copies combine in each task before the shuffle, so a hot copy travels once
   a task. Texts are stored in blocks (a hash of the text), bucketed by block: later steps read a block without a shuffle.
2. Every 50-byte window names a smallest 24-byte hash in it as its anchor: equal windows
   name equal anchors. A run of windows with one anchor is a region, 76 bytes at most. Anchors
   travel as packed arrays of hash, region digest and id, and equal ones combine before they do: of a region that many texts of a block hold, two smallest ids are sent, so
   a passage that all documents share costs a row a chunk of text, not a row a document. An anchor with one id only ends here. Of equal
   regions the text with the smallest id keeps its own and the others lose theirs; blocks get these decisions, not texts.
3. Where an anchor has several regions, one of each travels by anchor. Each task drops stretches without a window that stands
   twice (a sorted list of window hashes), cuts the rest into shards, builds the Burrows-Wheeler transform of each, and merges all shards by refining their interleave: a round stably sorts by the
   two preceding symbols, after h rounds suffixes stand in order of their first 2h symbols and blocks of equal ones are known.
   After 25 rounds the blocks are the repeated 50-byte intervals; nothing is sorted again.
4. An anchor with over ``crowd`` different regions doesn't meet in one task (a size switch). Its windows are
   digested (128 bits) and aggregated by digest, which combines before the shuffle.
5. Removed intervals meet their text again, block by block; results per text are joined to the documents that hold it.

Buckets and blocks are counted from the bytes of the input, so what a task holds does not grow with the corpus. Defined results: null
and empty texts have 0 bytes and no span, and the digest of no bytes; rows with one id are one document and remove nothing from each other where
equal; a null id counts as larger than any other; other columns are ignored. Ids are integers, since their order decides: other types are refused.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..shared import Workspace, passing_shuffles, within

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
CROWD = 20_000
SHARD_BYTES = 1 << 20
TASK_BYTES = 32 << 20  # of text a task
RUN = 1 << 18  # bytes hashed at a time
CHUNK = 1_000_000  # regions packed at a time
FINE = 8  # buckets of regions a task merges, one after the other
SEEN = 200_000  # digests a task remembers when it combines copies
LAST = (1 << 63) - 1
FACTOR = 0xD6E8FEB86659FD93
BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=50) for b in range(256)], dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse modulo 2**64."""
    n = RUN + LENGTH
    up, down = np.full(n + 1, FACTOR, dtype=np.uint64), np.full(n + 1, pow(FACTOR, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def sums(b: np.ndarray) -> np.ndarray:
    """Running sums, from which the hash of any stretch follows: (s[b] - s[a]) over the a-th power, mixed."""
    out = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(BYTES[b] * _powers()[0][: len(b)], out=out[1:])
    return out


def window_hashes(s: np.ndarray, size: int) -> np.ndarray:
    n = len(s) - size
    return mix((s[size:] - s[:n]) * _powers()[1][:n])


def _runs(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, first byte, end of window starts): whole texts up to a run of bytes, or a part of a long one."""
    row, n = 0, len(offsets) - 1
    while row < n:
        size = offsets[row + 1] - offsets[row]
        if size > RUN:
            for at in range(int(offsets[row]), int(offsets[row + 1]), RUN):
                yield row, row + 1, at, min(at + RUN, int(offsets[row + 1]))
            row += 1
        else:
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + RUN, "right")) - 1)
            yield row, to, int(offsets[row]), int(offsets[to])
            row = to


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """The places, of ``n`` from 0 on, where a window starts that ends in its text."""
    ends = np.zeros(n + 1, dtype=np.int32)
    whole = np.diff(offsets) >= LENGTH
    np.add.at(ends, np.clip(offsets[:-1][whole], 0, n), 1)
    np.add.at(ends, np.clip(offsets[1:][whole] - LENGTH + 1, 0, n), -1)
    return np.flatnonzero(np.cumsum(ends[:-1]))


def regions(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, first and last window (as places in ``data``), anchor and digest (48 bits each) of the regions of texts that lie end to end, a run at a time.

    The low bits of an anchor's hash tell its place, counted from the start of its text, so the smallest of a stretch is found by plain minima and a text has the same
    regions wherever it lies. A long text is cut between two windows; that splits a region, which stays under its anchor."""
    for low_row, high_row, start, until in _runs(offsets):
        stop = min(until + LENGTH - 1, int(offsets[high_row]))
        n = min(until - start, stop - start - LENGTH + 1)
        if n <= 0:
            continue
        s = sums(data[start:stop])
        least = window_hashes(s, GRAM)
        own = offsets[low_row:high_row]
        behind = start + np.arange(len(least)) - np.repeat(own, np.diff(np.r_[np.maximum(own, start), stop]))[: len(least)]
        least = (least & ~np.uint64(63)) | (behind & 63).astype(np.uint64)
        have = 1
        while have < SPAN:
            by = min(have, SPAN - have)
            least = np.minimum(least[by:], least[:-by])
            have += by
        at = _inside(offsets[low_row : high_row + 1] - start, n)
        if not len(at):
            continue
        least = least[at]
        place = at + (((least & np.uint64(63)).astype(np.int64) - behind[at]) & 63)
        cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        first, last = at[cut], at[np.r_[cut[1:] - 1, len(at) - 1]]
        digest = mix((s[last + LENGTH] - s[first]) * _powers()[1][first] + (last - first).astype(np.uint64))
        row = np.searchsorted(offsets, start + first, "right") - 1
        yield row, start + first, start + last, mix(least[cut] >> np.uint64(6)) >> np.uint64(16), digest >> np.uint64(16)


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, "<i8" if pa.types.is_large_binary(column.type) else "<i4")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, dtype=np.uint8), offsets.astype(np.int64)


def _ints(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _both(g: np.ndarray, digest: np.ndarray) -> np.ndarray:
    return mix(g * np.uint64(FACTOR) + digest)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once a task; later copies only if their id is smaller, and then without the text."""
    least: dict[bytes, int] = {}
    late: dict[bytes, tuple[int, int]] = {}
    schema = pa.schema([("block", pa.int32()), ("digest", pa.binary()), ("low", pa.int64()), ("data", pa.binary())])

    def rest() -> pa.RecordBatch:
        rows = [(b, d, low, None) for d, (b, low) in late.items()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema.types, strict=True)], schema=schema)

    for batch in batches:
        new = []
        for i, (block, digest, low) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            known = least.get(digest)
            if known is None:
                new.append(i)
            elif low < known:
                late[digest] = block, low
            if known is None or low < known:
                least[digest] = low
        yield pa.record_batch(batch.take(pa.array(new, pa.int64())).columns, schema=schema)
        if len(least) > SEEN:
            yield rest()
            least, late = {}, {}
    yield rest()


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a text, of what ``_combine`` left; a task holds the texts of its blocks."""
    number: dict[bytes, int] = {}
    lows: list[int] = []
    held = []
    for batch in batches:
        new = []
        whole = batch.column(3).is_valid().to_pylist()
        for i, (digest, low) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            k = number.setdefault(digest, len(lows))
            if k == len(lows):
                lows.append(low)
            elif low < lows[k]:
                lows[k] = low
            if whole[i] and k >= 0:
                new.append((i, k))
        held.append((batch, new))
    given: set[int] = set()
    for batch, new in held:
        own = []
        for i, k in new:
            if k not in given:
                given.add(k)
                own.append((i, k))
        if own:
            out = batch.take(pa.array([i for i, _ in own]))
            yield pa.record_batch({"block": out.column(0), "digest": out.column(1), "low": pa.array([lows[k] for _, k in own], pa.int64()), "data": out.column(3)})


_ANCHORS = pa.schema([("bucket", pa.int32()), ("anchors", pa.binary()), ("regions", pa.binary()), ("holders", pa.binary()), ("blocks", pa.binary()), ("lows", pa.binary())])


def _anchors(buckets: int):
    """By bucket of anchors: anchor, region and holder of each region, and block and id of the holders. Of a region that
    several texts of a block and chunk hold, the two smallest different ids are sent."""

    def pack(held: list, blocks: np.ndarray, lows: np.ndarray) -> pa.RecordBatch:
        g, digest, text = (np.concatenate(c) for c in zip(*held, strict=True))
        key = _both(g, digest) + blocks[text].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(lows[text], kind="stable")
        order = order[np.argsort(key[order], kind="stable")]
        key, g, digest, text = key[order], g[order], digest[order], text[order]
        block, low = blocks[text], lows[text]
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (g[1:] != g[:-1]) | (digest[1:] != digest[:-1]) | (block[1:] != block[:-1])])
        more = low != np.repeat(low[start], np.diff(np.r_[start, len(low)]))
        at = np.r_[start, np.flatnonzero(more & ~np.r_[False, more[:-1]])]
        g, digest, text = g[at], digest[at], text[at]
        bucket = (g % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows = []
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            own, local = np.unique(text[part], return_inverse=True)
            rows.append((int(bucket[part[0]]), _six(g[part]), _six(digest[part]), local.astype("<u4").tobytes(), blocks[own].astype("<i4").tobytes(), lows[own].astype("<i8").tobytes()))
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ANCHORS.types, strict=True)], schema=_ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, blocks, lows = [], 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            base = len(blocks)
            blocks, lows = np.r_[blocks, _ints(batch.column(0))], np.r_[lows, _ints(batch.column(1))]
            for row, _, _, g, digest in regions(*_flat(batch.column(2))):
                held.append((g, digest, base + row))
                size += len(g)
                if size >= CHUNK:
                    yield pack(held, blocks, lows)
                    held, size = [], 0
            if not held:
                blocks, lows = blocks[:0], lows[:0]
        if held:
            yield pack(held, blocks, lows)

    return run


_DECIDED = pa.schema([("block", pa.int32()), ("anchors", pa.binary()), ("regions", pa.binary()), ("lows", pa.binary()), ("marks", pa.binary())])


def _decide(crowd: int):
    """For the anchors of a bucket, by block: the smallest id of each region, and whether its windows must be compared with those of other regions (1), in a crowd (2), or not (0)."""

    def bucket(rows: list) -> tuple[np.ndarray, ...] | None:
        g, digest = (_from_six(b"".join(r[c] for r in rows)) for c in (0, 1))
        base = np.cumsum([0, *(len(r[3]) // 4 for r in rows)])
        holder = np.concatenate([np.frombuffer(r[2], "<u4").astype(np.int64) + b for r, b in zip(rows, base, strict=False)])
        blocks, lows = np.frombuffer(b"".join(r[3] for r in rows), "<i4"), np.frombuffer(b"".join(r[4] for r in rows), "<i8")
        # most anchors stand once
        order = np.argsort(g)
        alike = g[order][1:] == g[order][:-1]
        order = order[np.r_[alike, False][: len(order)] | np.r_[False, alike][: len(order)]]
        if not len(order):
            return None
        g, digest, block, low = g[order], digest[order], blocks[holder[order]], lows[holder[order]]
        order = np.lexsort((block, low, digest, g))
        g, digest, block, low = g[order], digest[order], block[order], low[order]
        new = np.r_[True, g[1:] != g[:-1]]
        new_region = new | np.r_[True, digest[1:] != digest[:-1]]
        start, region_start = np.flatnonzero(new), np.flatnonzero(new_region)
        group, region = np.cumsum(new) - 1, np.cumsum(new_region) - 1
        least = low[region_start][region]
        several = (np.maximum.reduceat(low, start) != np.minimum.reduceat(low, start))[group]
        n_regions = np.add.reduceat(new_region.astype(np.int64), start)[group]
        mark = np.where(n_regions == 1, 0, np.where(n_regions <= crowd, 1, 2))
        use = np.flatnonzero(several & ((mark > 0) | (low > least)))
        use = use[np.lexsort((region[use], block[use]))]
        use = use[np.r_[True, (region[use][1:] != region[use][:-1]) | (block[use][1:] != block[use][:-1])][: len(use)]]
        return block[use], g[use], digest[use], least[use], mark[use].astype("u1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for x in _by_bucket(batches, bucket) if x is not None]
        if found:
            block, g, digest, least, mark = map(np.concatenate, zip(*found, strict=True))
            order = np.argsort(block, kind="stable")
            rows = []
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
                rows.append((int(block[part[0]]), _six(g[part]), _six(digest[part]), least[part].astype("<i8").tobytes(), mark[part].tobytes()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _DECIDED.types, strict=True)], schema=_DECIDED)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], work):
    """Calls ``work`` with the rows (less the bucket) of each bucket; rows come sorted by it."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now and rows:
                yield work(rows)
                rows = []
            now = row[0]
            rows.append(row[1:])
    if rows:
        yield work(rows)


_PIECES = pa.schema([("kind", pa.int32()), ("at", pa.int32()), ("key", pa.int64()), ("low", pa.int64()), ("spans", pa.binary()), ("payload", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64())])
_HOLDER = np.dtype([("key", "<i8"), ("low", "<i8"), ("block", "<i4"), ("start", "<i4"), ("size", "<i4")])


def _collect(buckets: int):
    """For the texts of a block and what was decided for it. Kind 1: stretches that a text loses; 2: regions to compare, by bucket; 3: windows of a crowd."""

    def block(texts: pa.Table, decided: pa.Table) -> pa.Table:
        rows = []
        if decided.num_rows:
            known = _both(*(_from_six(b"".join(decided.column(c).to_pylist())) for c in ("anchors", "regions")))
            order = np.argsort(known)
            known = known[order]
            least = np.frombuffer(b"".join(decided.column("lows").to_pylist()), "<i8")[order]
            mark = np.frombuffer(b"".join(decided.column("marks").to_pylist()), "u1")[order]
            number = decided.column("block")[0].as_py()
            data, offsets = _flat(texts.column("data"))
            keys, lows = _ints(texts.column("key")), _ints(texts.column("low"))
            shared: dict[int, list] = {}
            raw = data.tobytes()
            met = np.zeros(len(known), dtype=bool)
            for row, first, last, g, digest in regions(data, offsets):
                both = _both(g, digest)
                at = np.minimum(np.searchsorted(known, both), len(known) - 1)
                hit = np.flatnonzero(known[at] == both)
                met[at[hit]] = True
                row, first, last, g, at = row[hit], first[hit], last[hit] + LENGTH, g[hit], at[hit]
                loses = lows[row] > least[at]
                spans = np.stack([first - offsets[row], last - offsets[row]], axis=1).astype("<i4")
                gone = np.flatnonzero(loses)
                for part in np.split(gone, np.flatnonzero(np.diff(row[gone])) + 1) if len(gone) else []:
                    k = row[part[0]]
                    rows.append((1, number, int(keys[k]), int(lows[k]), spans[part].tobytes(), None, None, None))
                for j in np.flatnonzero(~loses & (mark[at] == 1)).tolist():
                    k = row[j]
                    shared.setdefault(int(g[j] % np.uint64(buckets)), []).append((keys[k], lows[k], number, spans[j, 0], last[j] - first[j], raw[first[j] : last[j]]))
                for j in np.flatnonzero(~loses & (mark[at] == 2)).tolist():
                    k, from_ = row[j], int(offsets[row[j]])
                    for a in range(int(first[j]), int(last[j]) - LENGTH + 1):
                        w = xxhash.xxh3_128_digest(raw[a : a + LENGTH])
                        rows.append((3, number, int(keys[k]), int(lows[k]), np.array([a - from_, a - from_ + LENGTH], "<i4").tobytes(), None, int.from_bytes(w[:8], "little", signed=True), int.from_bytes(w[8:], "little", signed=True)))
            if not met.all():
                raise RuntimeError(f"{len(met) - int(met.sum())} regions that were decided for block {number} are not in its texts")
            for b, own in shared.items():
                rows.append((2, b, None, None, np.array([x[:5] for x in own], dtype=_HOLDER).tobytes(), b"".join(x[5] for x in own), None, None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, _PIECES.types, strict=True)], schema=_PIECES)

    return block


def transform(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of strings of symbols (1 to 255), each closed by 0; ties end by number of string. From 8 symbols on, ranks are doubled."""
    n, depth = len(codes), 8
    string = np.repeat(np.arange(len(ends)), np.diff(np.r_[-1, ends]))
    left = ends[string] - np.arange(n) + 1  # symbols up to and with the end mark
    padded = np.r_[codes, np.zeros(8, dtype=codes.dtype)].astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | np.where(left > j, padded[j : j + n], 0).astype(np.uint64)
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        if depth >= 2 * left.max():
            return order
        after = np.where(left <= depth, string, len(ends) + np.r_[rank[depth:], np.zeros(min(depth, n), dtype=np.int64)][:n])
        key = rank.astype(np.uint64) * np.uint64(n + len(ends) + 1) + after.astype(np.uint64)
        depth *= 2


def interleave(pairs: list[np.ndarray], tails: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms two symbols a round. ``pairs`` gives, in a shard's suffix order, the two symbols before each suffix
    (0 where its text has not two before it); ``tails`` the first pairs of the suffixes of one or two symbols, ascending, which
    nothing leads to. Returns the shard of each suffix in merged order, and its block: suffixes with equal first 2 x ``rounds`` symbols."""
    shard = np.repeat(np.arange(len(pairs), dtype=np.uint16), [len(t) for t in pairs])
    flat = np.concatenate(pairs)
    fixed = np.concatenate(tails)
    own = np.repeat(np.arange(len(tails), dtype=np.uint16), [len(t) for t in tails])
    own, fixed = own[(o := np.argsort(fixed, kind="stable"))], fixed[o]
    block = np.zeros(len(shard), dtype=np.int32)
    before = np.full(len(fixed), -1, dtype=np.int32)
    symbol = np.empty(len(shard), dtype=np.uint16)
    for _ in range(rounds):
        # each shard's suffixes keep their order, so its symbols are read in turn
        symbol[np.argsort(shard, kind="stable")] = flat
        led = np.flatnonzero(symbol)
        code = np.concatenate([fixed, symbol[led]])
        order = np.argsort(code, kind="stable")
        code = code[order]
        source = np.concatenate([before, block[led]])[order]
        shard = np.concatenate([own, shard[led]])[order]
        block = np.cumsum(np.r_[False, (code[1:] != code[:-1]) | (source[1:] != source[:-1])], dtype=np.int32)
    return shard, block


def repeated(texts: list[bytes], lows: np.ndarray, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, smallest id) of all 50-byte windows; the id is the smallest of the texts that hold the window."""
    used = np.flatnonzero(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
    if len(used) > 255:
        raise ValueError("texts are UTF-8, which leaves some bytes out")
    table = np.zeros(256, dtype=np.uint8)
    table[used] = np.arange(1, len(used) + 1)
    shards, size = [[]], 0
    for i, t in enumerate(texts):
        if size >= shard_bytes:
            shards.append([])
            size = 0
        shards[-1].append(i)
        size += len(t)
    pairs, tails, owners, places = [], [], [], []
    for own in shards:
        sizes = np.array([len(texts[i]) + 1 for i in own])
        ends = np.cumsum(sizes) - 1
        codes = np.zeros(ends[-1] + 1, dtype=np.uint8)
        inside = np.ones(len(codes), dtype=bool)
        inside[ends] = False
        codes[inside] = table[np.frombuffer(b"".join(texts[i] for i in own), np.uint8)]
        order = transform(codes, ends)
        first = np.repeat(ends - sizes + 1, sizes)
        place = np.arange(len(codes)) - first
        wide = codes.astype(np.uint16)
        both = np.r_[np.zeros(2, np.uint16), (wide[:-2] << 8) | wide[1:-1]]
        both[place < 2] = 0
        pairs.append(both[order])
        short = np.r_[ends, ends - 1]
        tails.append(np.sort((wide[short] << 8)))
        text = np.repeat(np.array(own), sizes)
        owners.append(text[order].astype(np.int32)), places.append(place[order].astype(np.int32))
    shard, block = interleave(pairs, tails, LENGTH // 2)
    text, place = np.empty(len(shard), dtype=np.int32), np.empty(len(shard), dtype=np.int32)
    by_shard = np.argsort(shard, kind="stable")
    text[by_shard], place[by_shard] = np.concatenate(owners), np.concatenate(places)
    sizes = np.array([len(t) for t in texts])
    whole = np.flatnonzero(place + LENGTH <= sizes[text])
    text, place, block = text[whole], place[whole], block[whole]
    start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
    least = np.repeat(np.minimum.reduceat(lows[text], start), np.diff(np.r_[start, len(text)])) if len(text) else lows[:0]
    return text, place, least


def _stretches(texts: list[bytes]) -> list[tuple[int, int, int]]:
    """(text, start, end) of the stretches whose windows' hashes all stand twice in ``texts``; other windows are equal to none."""
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    hashes, places = [], []
    for low, high, start, until in _runs(offsets):
        stop = min(until + LENGTH - 1, int(offsets[high]))
        n = min(until - start, stop - start - LENGTH + 1)
        if n > 0:
            at = _inside(offsets[low : high + 1] - start, n)
            hashes.append(window_hashes(sums(data[start:stop]), LENGTH)[at])
            places.append(start + at)
    if not hashes:
        return []
    h, at = np.concatenate(hashes), np.concatenate(places)
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return []
    at = at[twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h]
    text = np.searchsorted(offsets, at, "right") - 1
    cut = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(text) != 0)])
    first, last = at[cut], at[np.r_[cut[1:] - 1, len(at) - 1]] + LENGTH
    own = text[cut]
    return list(zip(own.tolist(), (first - offsets[own]).tolist(), (last - offsets[own]).tolist(), strict=True))


_SPANS = pa.schema([("block", pa.int32()), ("key", pa.int64()), ("low", pa.int64()), ("spans", pa.binary())])


def _merge(shard_bytes: int):
    def bucket(rows: list) -> pa.RecordBatch:
        number: dict[bytes, int] = {}  # equal regions are compared once
        lows: list[int] = []
        which = []
        holders = np.frombuffer(b"".join(r[0] for r in rows), _HOLDER)
        at, raw = 0, b"".join(r[1] for r in rows)
        for low, n in zip(holders["low"].tolist(), holders["size"].tolist(), strict=True):
            i = number.setdefault(raw[at : at + n], len(lows))
            if i == len(lows):
                lows.append(low)
            elif low < lows[i]:
                lows[i] = low
            which.append(i)
            at += n
        texts, least_of = list(number), np.array(lows, dtype=np.int64)
        cut = _stretches(texts)
        out: list[tuple[int, int, int, bytes]] = []
        runs: dict[int, list[np.ndarray]] = {}
        if cut:
            source, shift = np.array([c[0] for c in cut]), np.array([c[1] for c in cut])
            part, place, least = repeated([texts[i][a:b] for i, a, b in cut], least_of[source], shard_bytes)
            gone = least < least_of[source[part]]
            part, place = part[gone], place[gone].astype(np.int64)
            order = np.lexsort((place, part))
            part, place = part[order], place[order]
            for p in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1) if len(part) else []:
                own = place[p] + shift[part[p[0]]]
                joins = np.flatnonzero(np.r_[True, np.diff(own) != 1])
                runs.setdefault(int(source[part[p[0]]]), []).append(np.stack([own[joins], np.r_[own[joins[1:] - 1], own[-1]] + LENGTH], axis=1))
        joined = {i: np.concatenate(v) for i, v in runs.items()}
        for i, h in zip(which, holders.tolist(), strict=True):
            key, low, block, start, size = h
            if low > lows[i]:
                out.append((block, key, low, np.array([start, start + size], "<i4").tobytes()))
            elif i in joined:
                out.append((block, key, low, (joined[i] + start).astype("<i4").tobytes()))
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, _SPANS.types, strict=True)], schema=_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_bucket(batches, bucket)

    return run


def union_of(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of sorted-out intervals (start, end)."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    far = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.r_[True, spans[1:, 0] > far[:-1]])
    return np.stack([spans[new, 0], far[np.r_[new[1:] - 1, len(spans) - 1]]], axis=1)


_RESULTS = pa.schema([("digest", pa.binary()), ("low", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("runs", pa.binary())])


def _cut(texts: pa.Table, spans: pa.Table) -> pa.Table:
    """What is left of the texts of a block."""
    found: dict[tuple[int, int], list[bytes]] = {}
    for key, low, span in zip(spans.column("key").to_pylist(), spans.column("low").to_pylist(), spans.column("spans").to_pylist(), strict=True):
        found.setdefault((key, low), []).append(span)
    data, offsets = _flat(texts.column("data"))
    rows = []
    for i, (key, low, digest) in enumerate(zip(texts.column("key").to_pylist(), texts.column("low").to_pylist(), texts.column("digest").to_pylist(), strict=True)):
        own = data[offsets[i] : offsets[i + 1]]
        runs = union_of(np.frombuffer(b"".join(found.get((key, low), [])), "<i4").reshape(-1, 2).astype(np.int64))
        kept, at = hashlib.sha256(), 0
        for a, b in runs.tolist():
            kept.update(own[at:a])
            at = b
        kept.update(own[at:])
        rows.append((digest, low, int((runs[:, 1] - runs[:, 0]).sum()), len(runs), kept.hexdigest(), runs.astype("<i4").tobytes()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _RESULTS.types, strict=True)], schema=_RESULTS)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, shard_bytes: int = SHARD_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``runs``: removed byte ranges as pairs of little-endian 32-bit numbers, null where a copy goes whole."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer column: the order of ids decides which text keeps a string")
    spark = docs.sparkSession
    ws = Workspace(spark, "substrings")
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data"))
    size = int(rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n *= max(1, -(-size // (task_bytes * n)))
    rows = rows.withColumn("digest", F.unhex(F.md5("data")))
    block = F.pmod(F.xxhash64("digest"), F.lit(4 * n)).cast("int")
    sent = rows.where(F.octet_length("data") >= LENGTH).select(block.alias("block"), "digest", F.coalesce("doc_id", F.lit(LAST)).alias("low"), "data").mapInArrow(_combine, "block int, digest binary, low long, data binary")
    unique = sent.repartition(n, "block").mapInArrow(_unite, "block int, digest binary, low long, data binary").withColumn("key", F.xxhash64("digest"))
    table = f"mnemex_texts_{uuid.uuid4().hex}"
    try:
        with passing_shuffles(spark):
            unique.write.option("path", ws.path("texts")).bucketBy(n, "block").saveAsTable(table)
        texts = spark.table(table)
        anchors = texts.select("block", "low", "data").mapInArrow(_anchors(2 * n), _ddl(_ANCHORS))
        decided = anchors.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_decide(crowd), _ddl(_DECIDED))
        met = texts.select("block", "key", "low", "data").groupBy("block").cogroup(decided.groupBy("block"))
        pieces = ws.save(met.applyInArrow(_collect(FINE * n), _ddl(_PIECES)), "pieces")
        mixed = pieces.where("kind = 2").select("at", "spans", "payload").repartition(n, "at").sortWithinPartitions("at")
        spans = pieces.where("kind = 1").select(F.col("at").alias("block"), "key", "low", "spans").union(mixed.mapInArrow(_merge(shard_bytes), _ddl(_SPANS)))
        crowded = pieces.where("kind = 3")
        if not within(crowded, 0):
            least = ws.save(crowded.groupBy("w1", "w2").agg(F.min("low").alias("least")), "crowded")
            spans = spans.union(crowded.join(least, ["w1", "w2"]).where("low > least").select(F.col("at").alias("block"), "key", "low", "spans"))
        cut = texts.select("block", "key", "low", "digest", "data").groupBy("block").cogroup(spans.groupBy("block"))
        cut = ws.save(cut.applyInArrow(_cut, _ddl(_RESULTS)), "results")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        ws.drop("texts"), ws.drop("pieces"), ws.drop("crowded")
    ids = rows.select("doc_id", "digest", F.octet_length("data").cast("long").alias("n_bytes"), F.when(F.octet_length("data") < LENGTH, F.sha2("data", 256)).alias("whole"))
    out = ids.join(cut, "digest", "left")
    copy = (F.coalesce("doc_id", F.lit(LAST)) > F.col("low")) & (F.col("n_bytes") >= LENGTH)
    return out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(~copy, F.coalesce("runs", F.unhex(F.lit("")))).alias("runs"),
    )


def op8(docs: DataFrame) -> DataFrame:
    return removed_spans(docs).drop("runs")
