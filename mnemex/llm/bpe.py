"""Byte-pair encoding as a bounded-lookahead transducer, and an incremental decoder.

A merge list is read once and its sufficient lookahead computed: how many
symbols to the right of a place can still change the tokens left of it. What lies right of a token acts on it only
through a chain of merges of rising rank, each of which has what the one before took or made as its
right part; the longest such chain, in symbols, bounds the reach. The transducer holds a window of
that many symbols beyond what it emits: a token is emitted once that lookahead is read, and
encoding restarts behind it, which is sound because no merge ever crossed its end. A text is read in parts of
``PART`` characters, cut at a space where a piece always begins; what has no such space is read piece by piece, a long piece symbol by symbol. Ids leave
in arrays of bounded size. So beyond the text itself (and, where it has no space to cut at, a normalised copy) memory is constant, whatever
the text's length. Short pieces and stretches between spaces repeat and are kept in tables that are emptied when full.

The decoder is a state machine: bytes of a character that tokens split are
held back until the character is complete. Ids are digested and decoded as they leave the transducer.

Files are of the tokenizers library: BPE over bytes, with or without normaliser and end-of-word
suffix. One map over whole texts, no shuffle. Defined results: null and empty texts have no ids and
decode to the empty text; strings of special tokens in a text become those tokens; equal rows are
encoded alike; null ids of documents and other columns pass.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CACHE = 300_000
PART = 1 << 18
STEP = 1 << 16  # ids that leave at a time
SHORT = 64  # longer strings are not kept


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Tokens:
    """Vocabulary, merges and pre-tokenisation of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        for rank, (a, b) in enumerate(pairs):
            made = self.vocab[a + b]
            self.merges[self.vocab[a], self.vocab[b]] = (rank, made)
        steps = spec.get("normalizer") or {}
        self.normal = [s["type"] for s in steps.get("normalizers", [steps] if steps else [])]
        pre = spec["pre_tokenizer"]
        self.keeps_space = pre["type"] == "ByteLevel" and pre["use_regex"]
        if self.keeps_space:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^SP\p{L}\p{N}]+|[SP]+(?![^SP])|[SP]+"
        else:
            pattern = next(p for p in pre["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"].replace(r"\s", "SP")
        self.pattern = regex.compile(pattern.replace("SP", SPACE))
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.joins_bytes = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        symbols = byte_symbols()
        self.byte_ids = [self.vocab[s] for s in symbols]
        self.last_ids = [self.vocab[s + self.suffix] for s in symbols]
        value = {s: b for b, s in enumerate(symbols)}
        self.bytes_of = {i: (t.encode() if i in self.special.values() else bytes(value[c] for c in t) if not self.suffix else b"") for i, t in self.text_of.items()}
        self.lookahead = sufficient_lookahead(self)

    def normalise(self, text: str) -> str:
        for step in self.normal:
            if step == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif step == "Lowercase":
                text = text.replace("Σ", "σ").lower()  # letter by letter, without regard to word ends
        return text


def sufficient_lookahead(tokens: Tokens) -> int:
    """Symbols beyond a place that can decide which tokens stand before it."""
    size = {i: len(t.removesuffix(tokens.suffix) if tokens.suffix else t) for t, i in tokens.vocab.items()}
    reach: dict[int, int] = {}  # by token that a chain of merges has taken or made so far
    most = 1
    for (a, b), (_, made) in sorted(tokens.merges.items(), key=lambda m: m[1][0]):
        far = size[made] + reach.get(b, 0)
        most = max(most, far)
        for t in (a, made):
            if reach.get(t, 0) < far:
                reach[t] = far
    return most


def merge(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Applies merges by rank, leftmost first."""
    none = (sys.maxsize, 0)
    if len(ids) > 64:
        return _merge_long(ids, merges)
    while len(ids) > 1:
        best, made, at = sys.maxsize, 0, -1
        prev = ids[0]
        for i in range(1, len(ids)):
            now = ids[i]
            rank, new = merges.get((prev, now), none)
            if rank < best:
                best, made, at = rank, new, i
            prev = now
        if at < 0:
            break
        ids[at - 1 : at + 1] = [made]
    return ids


def _merge_long(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(n - 1) if (r := merges.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, made, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = made, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            if r := merges.get((made, ids[after[j]])):
                heapq.heappush(heap, (r[0], i, r[1], made, ids[after[j]]))
        if (h := before[i]) >= 0 and (r := merges.get((ids[h], made))):
            heapq.heappush(heap, (r[0], h, r[1], ids[h], made))
    return [x for x in ids if x >= 0]


class Transducer:
    """Text in, ids out."""

    def __init__(self, tokens: Tokens, cache: int = CACHE):
        self.tokens, self.cache = tokens, cache
        self.lookahead = tokens.lookahead
        self.window = 4 * self.lookahead + 64
        self.size_of = {i: len(t.removesuffix(tokens.suffix) if tokens.suffix else t) for t, i in tokens.vocab.items()}
        self.pieces: dict[str, list[int]] = {}

    def stable(self, symbols: Iterable[int], last: list[int] | None = None) -> Iterator[int]:
        """Tokens of one piece, each emitted once the symbols read make it final; never more than a window is held."""
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) >= self.window:
                done, room = 0, len(held) - self.lookahead
                for t in merge(held.copy(), self.tokens.merges):
                    if done + self.size_of[t] > room:
                        break
                    done += self.size_of[t]
                    yield t
                del held[:done]
        yield from merge(held, self.tokens.merges)

    def symbols(self, text: str) -> Iterator[int]:
        byte_ids, last = self.tokens.byte_ids, None
        for i in range(0, len(text), STEP):
            for b in text[i : i + STEP].encode("utf-8", "surrogatepass"):
                if last is not None:
                    yield byte_ids[last]
                last = b
        if last is not None:
            yield self.tokens.last_ids[last]

    def piece(self, text: str) -> list[int]:
        """Ids of a short piece."""
        data = text.encode("utf-8", "surrogatepass")
        byte_ids = self.tokens.byte_ids
        symbols = [byte_ids[b] for b in data]
        symbols[-1] = self.tokens.last_ids[data[-1]]
        return merge(symbols, self.tokens.merges) if len(symbols) < self.window else list(self.stable(symbols))

    def ids(self, text: str) -> Iterator[int]:
        """Ids of a stretch between two safe places, special tokens and all, one after the other."""
        tokens = self.tokens
        at, special = 0, tokens.splitter.finditer(text) if tokens.splitter and "<" in text else ()
        for m in (*special, None):
            part = text[at : m.start() if m else None]
            for x in tokens.pattern.finditer(tokens.normalise(part)) if part else ():
                if x.end() - x.start() >= SHORT:
                    yield from self.stable(self.symbols(x[0]))
                    continue
                ids = self.pieces.get(x[0])
                if ids is None:
                    if len(self.pieces) >= self.cache:
                        self.pieces.clear()
                    ids = self.pieces[x[0]] = self.piece(x[0])
                yield from ids
            if m:
                yield tokens.special[m[0]]
                at = m.end()


def arrays(ids: Iterator[int]) -> Iterator[bytes]:
    """Ids as little-endian 32-bit numbers, ``STEP`` at a time."""
    while len(part := np.fromiter(islice(ids, STEP), dtype="<u4")):
        yield part.tobytes()


class Encoder(dict):
    """Ids of chunks as bytes (little-endian, 32 bits), by chunk; ``misses`` are encoded when asked for."""

    def __init__(self, tokens: Tokens, cache: int = CACHE, pieces: int | None = None):
        super().__init__()
        self.tokens, self.limit, self.machine = tokens, cache, Transducer(tokens, cache if pieces is None else pieces)
        self.odd_space = regex.compile(f" (?=[{SPACE}]|\\Z)")
        self.cut = regex.compile(f" (?=[^{SPACE}])")
        self.white = regex.compile(f"[{SPACE}]")

    def spaced(self, chunk: str) -> str:
        return " " + chunk if self.tokens.keeps_space else chunk

    def __missing__(self, chunk: str) -> bytes:
        ids = b"".join(arrays(self.machine.ids(self.spaced(chunk))))
        if len(chunk) < SHORT:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = ids
        return ids

    def chunks(self, text: str) -> list[str]:
        """Cut at spaces where a piece always begins; all but the first had a space before them."""
        if not self.tokens.keeps_space or not self.odd_space.search(text):
            return text.split(" ")
        return self.cut.split(text)

    def _part(self, text: str, first: bool) -> bytes:
        chunks = self.chunks(text)
        if not first or not self.tokens.keeps_space:
            return b"".join(map(self.__getitem__, chunks))
        head = b"".join(arrays(self.machine.ids(chunks[0]))) if chunks[0] else b""
        return head + b"".join(map(self.__getitem__, chunks[1:]))

    def _last_cut(self, text: str, low: int, high: int) -> int:
        """The last safe space from ``low`` on that ``text[:high]`` tells to be one, or -1."""
        at = text.rfind(" ", low, high - 1)
        while at >= 0 and self.white.match(text, at + 1):
            at = text.rfind(" ", low, at)
        return at

    def stream(self, text: str | None) -> Iterator[bytes]:
        """Ids of a whole text in parts of bounded size."""
        at, n = 0, len(text or "")
        while at < n:
            end = n if n - at <= PART else self._last_cut(text, at + 1, at + PART)
            if end < 0:
                found = self.cut.search(text, at + PART - 1)
                end = found.start() if found else n
            if end - at <= PART:
                yield self._part(text[at:end], at == 0)
            else:  # no safe space in a whole part
                yield from arrays(self.machine.ids(text[at:end] if at == 0 else self.spaced(text[at:end])))
            at = end + 1

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.stream(text))

    def encode_parts(self, parts: Iterable[str]) -> Iterator[bytes]:
        """Ids of a text that comes in parts; holds back what stands behind the last safe space."""
        held: list[str] = []  # the first begins a stretch; no safe space lies in or between them
        first = True
        for part in parts:
            tail = held[-1][-1:] if held else ""
            both = tail + part
            cut = self._last_cut(both, 0, len(both))
            if cut < 0 or not part:
                held += [part] if part else []
                continue
            text = "".join(held)[: -1 if tail else None] + both[:cut]
            if text or not first:
                yield from self._stretch(text, first)
            first, held = False, [both[cut + 1 :]]
        text = "".join(held)
        if text:
            yield from self._stretch(text, first)

    def _stretch(self, text: str, first: bool) -> Iterator[bytes]:
        if first or not self.tokens.keeps_space:
            yield from self.stream(text)
        else:  # a space stood before it
            yield from self.stream(" " + text)


class Decoder:
    """Incremental: ``feed`` ids as they come, ``finish`` gives what an unfinished character leaves."""

    def __init__(self, tokens: Tokens):
        self.tokens, self.first = tokens, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if self.tokens.joins_bytes:
            return self.utf8.decode(b"".join(map(self.tokens.bytes_of.__getitem__, ids)))
        text = " ".join(map(self.tokens.text_of.__getitem__, ids))
        if not text:
            return ""
        text, self.first = (text if self.first else " " + text), False
        return text

    def finish(self) -> str:
        return self.utf8.decode(b"", True) if self.tokens.joins_bytes else ""


def decode(ids: np.ndarray, tokens: Tokens) -> Iterator[str]:
    machine = Decoder(tokens)
    for i in range(0, len(ids), STEP):
        yield machine.feed(ids[i : i + STEP].tolist())
    yield machine.finish()


@lru_cache(maxsize=4)
def loaded(path: str, cache: int, pieces: int) -> Encoder:
    """One encoder a worker process: its tables serve all tasks that the process runs."""
    return Encoder(Tokens(path), cache, pieces)


def _digests(path: str, keep_ids: bool, cache: int, pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path, cache, pieces)
        tokens = encoder.tokens
        for batch in batches:
            counts, id_sums, text_sums, lists = [], [], [], []
            for x in batch.column(1):
                n, data, text, machine, kept = 0, hashlib.sha256(), hashlib.sha256(), Decoder(tokens), []
                for part in encoder.stream(x.as_py()):
                    data.update(part)
                    ids = np.frombuffer(part, "<u4")
                    n += len(ids)
                    for i in range(0, len(ids), STEP):
                        text.update(machine.feed(ids[i : i + STEP].tolist()).encode("utf-8", "surrogatepass"))
                    if keep_ids:
                        kept.append(ids.astype(np.int32))
                text.update(machine.finish().encode("utf-8", "surrogatepass"))
                counts.append(n)
                id_sums.append(data.hexdigest())
                text_sums.append(text.hexdigest())
                if keep_ids:
                    lists.append(np.concatenate([np.zeros(0, np.int32), *kept]))
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(id_sums, pa.string()), "decoded_sha256": pa.array(text_sums, pa.string())}
            if keep_ids:
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))
            yield pa.record_batch(columns)

    return run


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, cache: int = CACHE, pieces: int = CACHE) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if kept, ``ids``; the file must stand at ``path`` on every worker.

    ``cache`` and ``pieces`` bound the tables of chunks and pieces that a worker process keeps: smaller ones take less memory and more time, results are the same."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_digests(path or tokenizer_path("word_bpe_49k.json"), keep_ids, cache, pieces), schema)


def op2(docs: DataFrame) -> DataFrame:
    return encode_documents(docs, keep_ids=False)
