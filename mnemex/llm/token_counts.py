"""Edit-aware token counts.

A document's pre-tokens are kept as leaves of a segment tree, each a run of them that begins where a pre-token always
begins (a space before something that is no space). Inner nodes hold sums of characters and of tokens. An
edit descends by characters to the leaves it touches, takes the leaf before
too if it reaches the start of one, and re-encodes those alone. The new leaves take the place of the old ones, nodes that grow too wide are split, and only sums on
the way to the root are updated. Nodes of a stored tree come into being where an edit passes; their sums are differences of running sums.

Trees are tables: ``build_trees`` encodes each text once and stores, per document, the text with characters and tokens of its leaves; ``apply_edits``
takes stored trees and returns the trees after the edits, so counts of the next revision start from there and a document without edits is not encoded again.

One map over whole texts, no shuffle. Defined results: null and empty texts count 0; offsets beyond the
text are cut to its end, null ones mean its start and end; edits apply in the order given, each to the text that the ones before left; no edits leave the count;
equal rows count alike; null ids and other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Workspace
from .bpe import CACHE, SHORT, Encoder, Tokens, tokenizer_path
from .token_files import fast_encoding

LEAF = 16
FAN = 32


class Leaf:
    __slots__ = ("text", "tokens")
    n_leaves = 1

    def __init__(self, text: str, tokens: int):
        self.text, self.tokens = text, tokens

    @property
    def chars(self) -> int:
        return len(self.text)


class Node:
    """Sums over up to ``FAN`` children, all leaves or all nodes of one height."""

    __slots__ = ("_kids", "_stored", "chars", "tokens", "n_leaves")

    def __init__(self, kids: list):
        self._kids, self._stored = kids, None
        self.chars, self.tokens, self.n_leaves = sum(k.chars for k in kids), sum(k.tokens for k in kids), sum(k.n_leaves for k in kids)

    @classmethod
    def stored(cls, text: str, ends: np.ndarray, sums: np.ndarray, low: int, high: int, height: int) -> Node:
        """The node over leaves from low to high (not included) of a stored tree; ``ends`` and ``sums`` run over characters and tokens of its leaves, from 0."""
        node = cls([])
        node._kids, node._stored = None, (text, ends, sums, low, high, height)
        node.chars, node.tokens, node.n_leaves = int(ends[high] - ends[low]), int(sums[high] - sums[low]), high - low
        return node

    @property
    def kids(self) -> list:
        if self._kids is None:
            text, ends, sums, low, high, height = self._stored
            if height == 1:
                at, tokens = ends[low : high + 1].tolist(), np.diff(sums[low : high + 1]).tolist()
                self._kids = [Leaf(text[a:b], n) for a, b, n in zip(at, at[1:], tokens, strict=False)]
            else:
                width = FAN ** (height - 1)
                self._kids = [Node.stored(text, ends, sums, a, min(a + width, high), height - 1) for a in range(low, high, width)]
            self._stored = None
        return self._kids

    def find(self, at: int) -> tuple[int, int]:
        """Number of the leaf that holds the character, and where in it."""
        before = 0
        for kid in self.kids:
            if at < kid.chars:
                inner = kid.find(at) if isinstance(kid, Node) else (0, at)
                return before + inner[0], inner[1]
            at -= kid.chars
            before += kid.n_leaves
        raise IndexError(at)

    def leaves(self, first: int, stop: int) -> Iterator[Leaf]:
        for kid in self.kids:
            if first < kid.n_leaves and stop > 0:
                if isinstance(kid, Node):
                    yield from kid.leaves(max(first, 0), stop)
                else:
                    yield kid
            first -= kid.n_leaves
            stop -= kid.n_leaves

    def replaced(self, first: int, stop: int, new: list[Leaf]) -> list:
        """What stands in this node's place, at its height, when leaves from first to stop (not included) give way to ``new``."""
        kids, given = [], False
        for kid in self.kids:
            n = kid.n_leaves
            if stop <= 0 and given or first >= n:
                kids.append(kid)
            elif isinstance(kid, Leaf):
                if not given:
                    kids += new
                    given = True
                if stop <= 0:
                    kids.append(kid)
            else:
                kids += kid.replaced(max(first, 0), min(stop, n), [] if given else new)
                given = True
            first -= n
            stop -= n
        return grouped(kids)


def grouped(kids: list) -> list[Node]:
    """Nodes of equal width over the children, none if there are none."""
    parts = -(-len(kids) // FAN)
    edges = [len(kids) * i // parts for i in range(parts + 1)] if parts else []
    return [Node(kids[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Counts(dict):
    """Tokens of a chunk with the space before it, by chunk. Short ones without a special token are counted by tiktoken with the ranks of the same file, others go through the transducer."""

    def __init__(self, path: str):
        super().__init__()
        self.whole = Encoder(Tokens(path))
        self.chunks = self.whole.chunks
        self.fast = fast_encoding(self.whole.tokens) if self.whole.tokens.keeps_space and not self.whole.tokens.suffix and not self.whole.tokens.normal else None

    def encode(self, text: str) -> bytes:
        return self.whole.encode(text)

    def __missing__(self, chunk: str) -> int:
        if self.fast is None or len(chunk) >= SHORT or "<" in chunk:
            return len(self.whole[chunk]) // 4
        if len(self) >= CACHE:
            self.clear()
        n = self[chunk] = len(self.fast.encode_ordinary(" " + chunk))
        return n


def leaf_sums(encoder: Counts, text: str, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of the leaves of a stretch; all but the first leaf of a document begin with a space."""
    if not text:
        return np.zeros(0, dtype="<i4"), np.zeros(0, dtype="<i4")
    chunks = encoder.chunks(text if first else text[1:])
    n = len(chunks)
    chars = np.fromiter(map(len, chunks), dtype=np.int64, count=n) + 1
    sizes = np.fromiter(map(encoder.__getitem__, chunks), dtype=np.int64, count=n)
    if first:
        chars[0], sizes[0] = chars[0] - 1, len(encoder.encode(chunks[0])) // 4
    starts = np.arange(0, n, LEAF)
    return np.add.reduceat(chars, starts).astype("<i4"), np.add.reduceat(sizes, starts).astype("<i4")


class TokenTree:
    """``leaves`` are those of a stored tree; without them the text is encoded."""

    def __init__(self, encoder: Counts, text: str, leaves: tuple[np.ndarray, np.ndarray] | None = None):
        self.encoder, self.reencoded = encoder, 0
        chars, tokens = leaf_sums(encoder, text, True) if leaves is None else leaves
        ends, sums = (np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(x, dtype=np.int64)]) for x in (chars, tokens))
        height = 1
        while FAN**height < len(chars):
            height += 1
        self.root = Node.stored(text, ends, sums, 0, len(chars), height)

    def _runs(self, text: str, first: bool) -> list[Leaf]:
        """Leaves of a stretch."""
        chars, tokens = leaf_sums(self.encoder, text, first)
        ends = np.cumsum(chars).tolist()
        return [Leaf(text[a:b], n) for a, b, n in zip([0, *ends], ends, tokens.tolist(), strict=False)]

    @staticmethod
    def _rooted(kids: list) -> Node:
        kids = grouped(kids) if not kids or isinstance(kids[0], Leaf) else kids
        while len(kids) > 1:
            kids = grouped(kids)
        root = kids[0] if kids else Node([])
        while len(root.kids) == 1 and isinstance(root.kids[0], Node):
            root = root.kids[0]
        return root

    @property
    def n_tokens(self) -> int:
        return self.root.tokens

    @property
    def n_chars(self) -> int:
        return self.root.chars

    @property
    def text(self) -> str:
        return "".join(x.text for x in self.root.leaves(0, self.root.n_leaves))

    def stored(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of the leaves."""
        own = list(self.root.leaves(0, self.root.n_leaves))
        return np.array([x.chars for x in own], dtype="<i4"), np.array([x.tokens for x in own], dtype="<i4")

    def edit(self, start: int, stop: int, insert: str) -> None:
        """Replaces the characters from start to stop."""
        size, n = self.n_chars, self.root.n_leaves
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        if start == stop and not insert:
            return
        if not n:
            self.root = self._rooted(self._runs(insert, True))
            self.reencoded += len(insert)
            return
        a, i = self.root.find(min(start, size - 1))
        i += start - min(start, size - 1)
        if i < 2 and a:  # the space and what follows it are what makes a leaf begin here
            a -= 1
            i += next(self.root.leaves(a, a + 1)).chars
        b = self.root.find(max(start, stop - 1))[0] if max(start, stop - 1) < size else n - 1
        b = max(a, b)
        if b + 1 < n and stop - start + i == sum(x.chars for x in self.root.leaves(a, b + 1)):
            b += 1  # what stands before the next leaf's space changes; its beginning may be gone with the rest
        region = "".join(x.text for x in self.root.leaves(a, b + 1))
        region = region[:i] + insert + region[i + stop - start :]
        self.reencoded += len(region)
        self.root = self._rooted(self.root.replaced(a, b + 1, self._runs(region, a == 0)))


@lru_cache(maxsize=2)
def loaded(path: str) -> Counts:
    return Counts(path)


def _build(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)
        for batch in batches:
            trees = []
            for x in batch.column(1):
                chars, tokens = leaf_sums(encoder, x.as_py() or "", True)
                trees.append((int(tokens.sum(dtype=np.int64)), chars.tobytes(), tokens.tobytes()))
            columns = list(zip(*trees, strict=True)) if trees else [[]] * 3
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True))], names=["doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens"])

    return run


def build_trees(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_tokens, leaf_chars, leaf_tokens``: the tree of each text; the last two are little-endian 32-bit numbers."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_build(path or tokenizer_path("byte_bpe_50k.json")), f"doc_id {kind}, text string, n_tokens long, leaf_chars binary, leaf_tokens binary")


EDITS = "array<struct<start:int,stop:int,insert:string>>"


def _apply(path: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, trees = [], []
            for text, before, chars, tokens, edits in zip(*(batch.column(i) for i in range(1, 6)), strict=True):
                text, before, chars, tokens, edits = text.as_py(), before.as_py(), chars.as_py(), tokens.as_py(), edits.as_py() or []
                if edits:
                    tree = TokenTree(loaded(path), text or "", (np.frombuffer(chars, "<i4"), np.frombuffer(tokens, "<i4")))
                    for step in edits:
                        tree.edit(step["start"] or 0, step["stop"] if step["stop"] is not None else tree.n_chars, step["insert"] or "")
                    rows.append((before, tree.n_tokens, tree.n_chars, tree.reencoded, len(edits)))
                    if keep:
                        trees.append((tree.text, *(x.tobytes() for x in tree.stored())))
                else:
                    rows.append((before, before, len(text or ""), 0, 0))
                    trees.append((text, chars, tokens))
            columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            names = ["n_tokens", "n_tokens_after", "n_chars_after", "n_chars_reencoded", "n_edits"]
            out = {"doc_id": batch.column(0), **dict(zip(names, map(pa.array, columns), strict=True))}
            if keep:
                stored = list(zip(*trees, strict=True)) if trees else [[]] * 3
                out |= {n: pa.array(c, t) for n, c, t in zip(("text", "leaf_chars", "leaf_tokens"), stored, (pa.string(), pa.binary(), pa.binary()), strict=True)}
            yield pa.record_batch(out)

    return run


def apply_edits(trees: DataFrame, edits, path: str | None = None, keep: bool = True) -> DataFrame:
    """Tokens of stored trees before and after ``edits``, a column of array<struct<start int, stop int, insert string>>; if ``keep``, with the trees they
    become: ``doc_id, n_tokens_after AS n_tokens, text, leaf_chars, leaf_tokens`` of the result are trees again."""
    kind = trees.schema["doc_id"].dataType.simpleString()
    rows = trees.select("doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens", edits.cast(EDITS).alias("edits"))
    schema = f"doc_id {kind}, n_tokens long, n_tokens_after long, n_chars_after long, n_chars_reencoded long, n_edits long"
    return rows.mapInArrow(_apply(path or tokenizer_path("byte_bpe_50k.json"), keep), schema + ", text string, leaf_chars binary, leaf_tokens binary" * keep)


def count_tokens(docs: DataFrame, edits=None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores the trees of all texts and counts what ``edits``, a column over (doc_id, text), make of them."""
    trees = Workspace(docs.sparkSession, "token-counts").save(build_trees(docs, path, id_col, text_col), "trees")
    return apply_edits(trees, F.lit(None) if edits is None else edits, path, keep=False)


def revision(text):
    """The edits that the query counts: a heading, a cut in the middle, a replacement near the end."""
    n = F.coalesce(F.length(text), F.lit(0))
    steps = [(F.lit(0), F.lit(0), "Revised. "), ((n / 2).cast("int"), (n / 2).cast("int") + 20, ""), ((n * 3 / 4).cast("int"), (n * 3 / 4).cast("int") + 5, "another wording")]
    return F.array(*[F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), F.lit(t).alias("insert")) for a, b, t in steps])


def op3(docs: DataFrame) -> DataFrame:
    return count_tokens(docs, revision(F.col("text")))
