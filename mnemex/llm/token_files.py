"""Token ids in Simple-8b words.

A word has 64 bits: a selector of 4, then 60 bits that hold 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1
ids of equal width. Ids of more than 60 bits take two words: selector 14 with the low 60 bits, selector 15 with the rest, so any word tells alone
what it holds. Ids are coded in blocks of 1,024; the offset of each block's first word
is stored, so blocks are coded in step with each other, and words of one selector are decoded at once.

A corpus is dealt out by ranges of (id, hash of text), sorted within each range, encoded, and written in
segments of a few million ids: each is a whole file image (header, ids and lengths of documents, block offsets, words). Segments travel as
binary cells of a table that Spark's writer commits, so a lost executor
leaves no half file and any Hadoop file system will do. Only lengths of segments are summed up
to find where each document starts; one row a range goes through one task.

Defined results: null and empty texts hold the end id alone; rows with one id follow each other by hash of text; a
null id comes first; an empty table gives no segment; other columns are ignored. Ids are integers, since files hold them as numbers in their order: other types are refused.

Texts are encoded by tiktoken with the ranks of the tokenizers file (the ids are the same, tests hold them against the library); a text with an endless run of one character,
``RUN`` or more, takes the transducer: a size switch.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegralType

from ..shared import Workspace, within
from .bpe import Encoder, Tokens, tokenizer_path

BLOCK = 1024
COUNTS = np.array(sorted({60 // w for w in range(1, 61)}, reverse=True))
WIDTHS = 60 // COUNTS
LOW60 = np.uint64((1 << 60) - 1)
HEAD = struct.Struct("<4sIQQQ")
MAGIC = b"S8B1"
SEGMENT_IDS = 2_000_000
BROADCAST_SEGMENTS = 200_000


def _width(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    bits = np.zeros(len(ids), dtype=np.uint8)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1 << step)
        bits += big.astype(np.uint8) * np.uint8(step)
        rest = np.where(big, rest >> np.uint64(step), rest)
    return bits + (rest > 0)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the offset of each block's first word (one more at the end)."""
    ids = np.asarray(ids, dtype="<u8")
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, "<u8"), np.zeros(1, "<u8")
    grid = np.zeros(blocks * BLOCK + 64, dtype="<u8")
    grid[:n] = ids
    need = np.zeros((blocks, BLOCK + 64), dtype=np.uint8)
    need[:, :BLOCK] = _width(grid[: blocks * BLOCK]).reshape(blocks, BLOCK)
    spans = {1: need}
    for p in (1, 2, 4, 8, 16):
        spans[2 * p] = np.maximum(spans[p][:, : spans[p].shape[1] - p], spans[p][:, p:])
    best = np.full((blocks, BLOCK), len(COUNTS), dtype=np.uint8)  # that of wide ids
    for s in range(len(COUNTS) - 1, -1, -1):
        c = int(COUNTS[s])
        p = 1 << (c.bit_length() - 1)
        most = np.maximum(spans[p][:, :BLOCK], spans[p][:, c - p : c - p + BLOCK])
        best[most <= WIDTHS[s]] = s
    step = np.r_[COUNTS, 1]
    at, rows, places, chosen = np.zeros(blocks, dtype=np.int64), [], [], []
    live = np.arange(blocks)
    length = np.full(blocks, BLOCK)
    length[-1] = n - (blocks - 1) * BLOCK
    while len(live):
        s = best[live, at[live]]
        rows.append(live), places.append(at[live].copy()), chosen.append(s)
        at[live] += step[s]
        live = live[at[live] < length[live]]
    row, place, s = map(np.concatenate, (rows, places, chosen))
    order = np.argsort(row * BLOCK + place, kind="stable")
    row, start, s = row[order], (row * BLOCK + place)[order], s[order]
    words = np.zeros(len(s), dtype="<u8")
    end = (row + 1) * BLOCK  # a word never takes from the next block
    for k in np.unique(s):
        own = np.flatnonzero(s == k)
        if k == len(COUNTS):
            words[own] = (grid[start[own]] & LOW60) | np.uint64(14 << 60)
            continue
        acc = np.full(len(own), np.uint64(int(k) << 60))
        for j in range(int(COUNTS[k])):
            place = start[own] + j
            acc |= np.where(place < end[own], grid[place], 0).astype("<u8") << np.uint64(j * int(WIDTHS[k]))
        words[own] = acc
    sizes = np.bincount(row, minlength=blocks)
    wide = np.flatnonzero(s == len(COUNTS))
    if len(wide):
        high = (grid[start[wide]] >> np.uint64(60)) | np.uint64(15 << 60)
        words = np.insert(words, wide + 1, high)
        sizes += np.bincount(row[wide], minlength=blocks)
    return words, np.r_[0, np.cumsum(sizes)].astype("<u8")


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ids of consecutive blocks; ``offsets`` are those of ``pack``, the last block may be short."""
    words = np.asarray(words, dtype="<u8")
    if not n:
        return np.zeros(0, "<u8")
    s = (words >> np.uint64(60)).astype(np.int64)
    held = np.r_[COUNTS, 1, 0][s]
    base = np.asarray(offsets, dtype=np.int64)
    ends = np.cumsum(held)
    first = ends - held
    block = np.repeat(np.arange(len(base) - 1), np.diff(base))
    start = first - first[base[block]] + block * BLOCK
    out = np.zeros((len(base) - 1) * BLOCK + 64, dtype="<u8")
    for k in np.unique(s):
        own = np.flatnonzero(s == k)
        if k == 15:
            out[start[own - 1]] |= (words[own] & LOW60) << np.uint64(60)
        elif k == 14:
            out[start[own]] = words[own] & LOW60
        else:
            mask = np.uint64((1 << int(WIDTHS[k])) - 1)
            for j in range(int(COUNTS[k])):
                place = start[own] + j
                ok = place < (block[own] + 1) * BLOCK
                out[place[ok]] = (words[own][ok] >> np.uint64(j * int(WIDTHS[k]))) & mask
    return out[:n]


def file_image(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    docs = np.array([0 if i is None else i for i in doc_ids], dtype="<i8")
    known = np.array([i is not None for i in doc_ids], dtype="u1")
    return b"".join([HEAD.pack(MAGIC, BLOCK, len(docs), len(ids), len(words)), docs.tobytes(), known.tobytes(), np.array(counts, dtype="<u8").tobytes(), offsets.astype("<u8").tobytes(), words.tobytes()])


def read_image(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Ids and lengths of the documents, and all their token ids."""
    magic, block, n_docs, n_ids, n_words = HEAD.unpack_from(data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a file of this format")
    at = HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, n, at)
        at += got.nbytes
        return got

    docs, known, counts = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    offsets = take("<u8", -(-n_ids // BLOCK) + 1)
    ids = unpack(take("<u8", n_words), offsets, n_ids)
    return [int(d) if k else None for d, k in zip(docs, known, strict=True)], counts.astype(np.int64), ids


# Fixed value: how byte-level vocabularies of this family split text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUN = 4096


def fast_encoding(tokens: Tokens):
    """tiktoken's encoding of a byte-level tokenizers file: its ids rise with the rank of their merges."""
    import tiktoken

    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={tokens.bytes_of[i]: i for i in tokens.vocab.values()}, special_tokens=tokens.special)


class FastEncoder:
    """Whole texts by tiktoken with the ranks of a tokenizers file: ids of byte-level files rise with the rank of their merges.

    The ids are those of the tokenizers library (a test holds them against it), at a third of its time. Texts with endless runs of one
    character, which its matcher can't backtrack through, take the transducer.
    """

    def __init__(self, path: str):
        tokens = Tokens(path)
        self.fast = fast_encoding(tokens)
        self.plain = Encoder(tokens, 50_000)
        self.endless = regex.compile(r"(.)\1{%d}" % RUN, regex.S)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) > RUN and self.endless.search(text):
            return self.plain.encode(text)
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


@lru_cache(maxsize=2)
def loaded(path: str) -> FastEncoder:
    return FastEncoder(path)


def _segments(path: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = loaded(path), TaskContext.get().partitionId(), 0
        docs, counts, data, held = [], [], [], 0
        end = np.array([end_id], dtype="<u4").tobytes()

        def out() -> pa.RecordBatch:
            image = file_image(docs, counts, np.frombuffer(b"".join(data), "<u4"))
            return pa.record_batch({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(docs)], pa.int64()), "n_ids": pa.array([held], pa.int64()), "payload": pa.array([image], pa.binary())})

        for batch in batches:
            for i, x in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(x.as_py()) + end
                docs.append(i.as_py()), counts.append(len(ids) // 4), data.append(ids)
                held += len(ids) // 4
                if held >= segment_ids:
                    yield out()
                    docs, counts, data, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield out()

    return run


def write_token_files(docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes all documents in ascending order of id to the folder ``out``."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer column: files hold ids as numbers, in their order")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.mapInArrow(_segments(path, end_id, segment_ids), "part int, seq int, n_docs long, n_ids long, payload binary").write.parquet(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, payload in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            docs, counts, ids = read_image(payload.as_py())
            ends = np.cumsum(counts)
            data = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.record_batch({
                "part": pa.array([part.as_py()] * len(docs), pa.int32()), "seq": pa.array([seq.as_py()] * len(docs), pa.int32()), "doc_id": pa.array(docs, pa.int64()),
                "local": pa.array(ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(sums, pa.int64()),
            })


def read_token_files(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("of_part"))  # one row a range
    own = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = files.select("part", "seq", own.alias("of_seq")).join(before, "part").select("part", "seq", (F.col("of_part") + F.col("of_seq")).alias("base"))
    docs = files.select("part", "seq", "payload").mapInArrow(_read, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    small = F.broadcast(starts) if within(files.select("part"), BROADCAST_SEGMENTS) else starts
    return docs.join(small, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op7(docs: DataFrame) -> DataFrame:
    ws = Workspace(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), ws.path("files"))
    return read_token_files(docs.sparkSession, ws.path("files"))
