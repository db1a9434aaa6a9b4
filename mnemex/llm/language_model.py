"""Katz backoff: n-grams counted over all documents that may be learned from, discounted by Good and Turing, with exactly normalised backoff weights.

P(w | h) = d(c) c(hw) / c(h) where hw was seen, else a(h) P(w | shorter h). Counts up to ``CUTOFF`` are discounted as Katz does; where the counts of counts don't allow that (a
factor outside of 0 to 1), by a constant. a(h) is what discounts leave, over what the shorter history gives to words not seen after h. A history that leaves nothing, because all its counts are high, counts one more. Words
learn from all tokens; one unknown word takes what is left of them, at least 1 / (N + V + 1). So the probabilities of all words and the unknown one add up to 1 after any history.

1. Texts become chunks: numbers of their words, and a hash of each different word. Chunks are a table, bucketed by chunk.
2. Level by level, from words on, a chunk asks: for each of its different n-grams (the number of the history, which the level before gave, and of the word) it sends how often it may learn it, to a bucket of the
   history. A history with more than a bucket's share of all tokens is spread over as many buckets as it has shares. A frequent n-gram costs a chunk one entry, however often it stands there.
3. A bucket adds up what all chunks sent, stores its n-grams with their counts (``kind=model``: the partitioned table of the level) and answers each chunk (``kind=answer``) with counts and, of each history, how many
   words follow it once, twice, ... and what the shorter history gives to them. Discounts need the counts of counts of all buckets, which are one row of sums; so weights are made from the answers.
4. A chunk takes the answers of all levels and evaluates its tokens from words up: the recursion, with the probability of the shorter history at hand.

Words and histories are told apart by 64-bit hashes and numbers made of place and bucket. Buckets are counted from the bytes of the input. Defined results: null, empty and word-less texts have the end as their only token; rows with equal ids are documents
of their own; where ``learn`` is null (as a null id makes it in ``op13``) a document isn't learned from; without any document to learn from every token is unknown and has probability 1; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Workspace, passing_shuffles

ORDER = 2
CUTOFF = 5
END = b" "  # no word
CHUNK_TOKENS = 1 << 20
TASK_BYTES = 16 << 20  # of text a bucket's task
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, as wide as the greatest, the bytes of one weight together and compressed."""
    most = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    planes = np.ascontiguousarray(x, dtype=f"<u{width}").view(np.uint8).reshape(-1, width).T
    return np.array([width, len(x)], dtype="<u4").tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    width, n = np.frombuffer(data, "<u4", 2).tolist()
    planes = np.frombuffer(pa.decompress(data[8:], width * n, "zstd"), np.uint8) if n else np.zeros(0, dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * FACTOR
    return x ^ (x >> np.uint64(29))


def discounts(n: list[int]) -> np.ndarray:
    """Factor of each count up to ``CUTOFF`` (that of 0 is 1), from how many n-grams were seen once, twice, ... ``CUTOFF`` + 1 times."""
    d = np.ones(CUTOFF + 1)
    if n[0]:
        high = (CUTOFF + 1) * n[CUTOFF] / n[0]
        katz = [((r + 1) * n[r] / (r * n[r - 1]) - high) / (1 - high) if n[r - 1] and high != 1 else 0.0 for r in range(1, CUTOFF + 1)]
        if all(0 < x < 1 for x in katz):
            d[1:] = katz
            return d
    off = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    d[1:] = [(r - off) / r for r in range(1, CUTOFF + 1)]
    return d


class Unigrams:
    """Probability of a word by its count."""

    def __init__(self, total: int, types: int, n: list[int]):
        self.total, self.types, self.d = total, types, discounts(n)
        left = sum((1 - self.d[r]) * r * n[r - 1] for r in range(1, CUTOFF + 1)) / total if total else 1.0
        self.unknown = max(left, 1 / (total + types + 1))
        self.scale = (1 - self.unknown) / (1 - left) if left < 1 else 0.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * self.d[np.minimum(c, CUTOFF + 1) % (CUTOFF + 1)] * c / max(self.total, 1), self.unknown)


def _discounted(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where(c > CUTOFF, 1.0, d[np.minimum(c, CUTOFF)]) * c


_CHUNKS = "chunk long, ids array<{}>, sizes binary, learn binary, codes binary, words binary"


def _chunks(kind: pa.DataType, limit: int):
    def row(number: int, ids: list, learn: list[bool], codes: list[np.ndarray], known: dict) -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), dtype="<u8", count=len(known))
        out = {"ids": pa.array([ids], pa.list_(kind)), "sizes": _pack(np.array([len(c) for c in codes])), "learn": np.array(learn, dtype="u1").tobytes(), "codes": _pack(np.concatenate(codes)), "words": hashes.tobytes()}
        return pa.record_batch({"chunk": pa.array([number], pa.int64())} | {k: v if k == "ids" else pa.array([v], pa.binary()) for k, v in out.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def fresh():
            known: dict[bytes, int] = defaultdict(count().__next__)
            known[END]
            return [], [], [], known, 0

        ids, learn, codes, known, size = fresh()
        for batch in batches:
            for key, text, use in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                words.append(END)
                codes.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
                ids.append(key), learn.append(bool(use))
                size += len(words)
                if size >= limit:
                    yield row(number, ids, learn, codes, known)
                    number += 1
                    ids, learn, codes, known, size = fresh()
        if ids:
            yield row(number, ids, learn, codes, known)

    return run


class Level:
    """The n-grams of one level in a chunk: the history and number of each different one, in the order in which they are asked for."""

    def __init__(self, grams: np.ndarray, history: np.ndarray, word: np.ndarray, bucket: np.ndarray):
        self.grams = grams  # at each place the number of its n-gram, or -1
        self.history, self.word, self.bucket = history, word, bucket  # of each different n-gram
        self.order = np.argsort(bucket, kind="stable")


class Reader:
    """A chunk and what it knows from the answers of the levels before."""

    def __init__(self, row: dict, answers: pa.Table | None, sums: list[dict], buckets: int):
        self.sizes, self.learn = _unpack(row["sizes"]), np.frombuffer(row["learn"], "u1").astype(bool)
        self.codes, self.hashes = _unpack(row["codes"]), np.frombuffer(row["words"], "<u8")
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.learned = np.repeat(self.learn, self.sizes)
        self.sums, self.buckets = sums, buckets
        self.answers: dict[int, dict[int, dict]] = {}
        for a in answers.to_pylist() if answers is not None else ():
            self.answers.setdefault(a["level"], {})[a["bucket"]] = a
        self.level = Level(self.codes, np.zeros(len(self.hashes), dtype=np.int64), np.arange(len(self.hashes)), (self.hashes % np.uint64(buckets)).astype(np.int64))
        for k, own in enumerate(sums, 1):
            self._take(k, own)

    def _numbers(self, level: int, column: str) -> np.ndarray:
        """What the buckets answered for each n-gram of the level."""
        own = self.answers.get(level, {})
        got = [_unpack(own[b][column]) for b in sorted(own)]
        out = np.zeros(len(self.level.order), dtype=np.int64)
        out[self.level.order] = np.concatenate(got) if got else 0
        return out

    def _take(self, level: int, own: dict) -> None:
        counts = self._numbers(level, "counts")
        self.ids = self._numbers(level, "numbers") if own["more"] else None
        if level == 1:
            self.words, self.word_counts = self.ids, counts
            self.p = Unigrams(own["total"], own["types"], own["n"])(counts)[self.codes]
        else:
            weight, extra = self._weights(level, discounts(own["n"]))
            at = np.flatnonzero(self.level.grams >= 0)
            gram, history = self.level.grams[at], self.context[at]
            c = counts[gram]
            seen = _discounted(discounts(own["n"]), c) / (self.context_counts + extra)[history]
            self.p[at] = np.where(c > 0, seen, weight[history] * self.p[at])
        self.counts = counts
        if own["more"]:
            self._next(level + 1)

    def _weights(self, level: int, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backoff weight of each history, and 1 for those that count one more."""
        n, lower = np.zeros((len(self.context_counts), CUTOFF)), np.zeros(len(self.context_counts))
        for b, a in self.answers.get(level, {}).items():
            own = self.asked(b)
            n[own] += _unpack(a["follow"]).reshape(-1, CUTOFF)
            lower[own] += np.frombuffer(a["lower"], "<f8")
        mass = (n * np.arange(1, CUTOFF + 1) * (1 - d[1:])).sum(axis=1)
        extra = np.where(mass > 0, 0, 1)
        return np.maximum(mass, extra) / np.maximum(self.context_counts + extra, 1) / np.maximum(1 - lower, 1e-300), extra

    def _next(self, level: int) -> None:
        """The n-grams one word longer: those whose history was seen."""
        context = np.zeros(len(self.codes), dtype=np.int64)
        before = np.where(self.level.grams >= 0, self.level.grams + 1, 0)
        context[1:] = before[:-1]
        context[self.starts] = 0
        begin = (1, sum_learn) if level == 2 and (sum_learn := self.sums[0]["documents"]) else (0, 0)
        self.context, self.context_ids, self.context_counts = context, np.r_[begin[0], self.ids], np.r_[begin[1], self.counts]
        use = self.context_counts[context] > 0
        at = np.flatnonzero(use)
        different, gram = np.unique(context[at] * len(self.hashes) + self.codes[at], return_inverse=True)
        grams = np.full(len(self.codes), -1, dtype=np.int64)
        grams[at] = gram
        history, word = different // len(self.hashes), different % len(self.hashes)
        self.share = np.maximum(1, -(-self.context_counts * self.buckets // max(1, self.sums[0]["total"])))  # buckets of a history
        base, spread = _mix(self.context_ids), self.share[history]
        apart = _mix(_mix(self.context_ids[history]) + self.hashes[word])
        bucket = (base[history] + apart % spread.astype(np.uint64)) % np.uint64(self.buckets)
        self.level = Level(grams, history, word, bucket.astype(np.int64))
        # histories that each bucket is asked for: those of its n-grams, and wide ones that are here at all
        wide = np.flatnonzero((self.share > 1) & (np.bincount(history, minlength=len(self.share)) > 0))
        more = np.repeat(wide, self.share[wide])
        turn = np.arange(len(more)) - np.repeat(np.cumsum(self.share[wide]) - self.share[wide], self.share[wide])
        more_bucket = ((base[more] + turn.astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
        both = np.unique(np.r_[self.level.bucket, more_bucket] * len(self.context_ids) + np.r_[history, more])
        self._asked_bucket, self._asked = both // len(self.context_ids), both % len(self.context_ids)

    def asked(self, bucket: int) -> np.ndarray:
        low, high = np.searchsorted(self._asked_bucket, [bucket, bucket + 1])
        return self._asked[low:high]

    def messages(self, chunk: int, level: int) -> list[tuple]:
        """By bucket: histories, how many n-grams of each, words, how often they may be learned, and what the shorter history gives to them (as places in a table)."""
        own = self.level
        at = np.flatnonzero(self.learned & (own.grams >= 0))
        times = np.bincount(own.grams[at], minlength=len(own.word))
        lower = np.zeros(len(own.word))
        if level > 1:
            use = own.grams >= 0
            lower[own.grams[use]] = self.p[use]
        out = []
        edges = np.searchsorted(own.bucket[own.order], np.arange(self.buckets + 1))
        asked = np.unique(own.bucket) if level == 1 else np.unique(self._asked_bucket)
        for b in asked.tolist():
            part = own.order[edges[b] : edges[b + 1]]
            if level == 1:
                out.append((b, chunk, None, None, self.hashes[part].tobytes(), _pack(times[part]), None, None))
                continue
            histories = self.asked(b)
            sizes = np.searchsorted(own.history[part], histories, "right") - np.searchsorted(own.history[part], histories, "left")
            table, place = np.unique(lower[part], return_inverse=True)
            out.append((b, chunk, _pack(self.context_ids[histories]), _pack(sizes), _pack(self.words[own.word[part]]), _pack(times[part]), _pack(place), table.astype("<f8").tobytes()))
        return out


_MESSAGE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("histories", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("times", pa.binary()), ("places", pa.binary()), ("table", pa.binary())])
_TOTALS = ["total", "types", *(f"n{r}" for r in range(1, CUTOFF + 2))]
_ANSWER = pa.schema([("kind", pa.string()), ("level", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("counts", pa.binary()), ("numbers", pa.binary()), ("follow", pa.binary()), ("lower", pa.binary()), ("histories", pa.binary()), ("words", pa.binary())] + [(t, pa.int64()) for t in _TOTALS])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


def _ask(level: int, sums: list[dict], buckets: int):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for row in chunk.to_pylist():
            rows += Reader(row, answers, sums, buckets).messages(row["chunk"], level)
        return _table(rows, _MESSAGE)

    return run


def _sum_up(level: int, buckets: int, more: bool):
    """Adds up what the chunks sent to a bucket, stores it and answers each."""

    def bucket(number: int, rows: list[dict]) -> pa.RecordBatch:
        own = [np.frombuffer(r["words"], "<u8") if level == 1 else _unpack(r["words"]) for r in rows]
        word, ends = np.concatenate(own), np.cumsum([len(x) for x in own])
        times = np.concatenate([_unpack(r["times"]) for r in rows])
        if level > 1:
            asked = [_unpack(r["histories"]) for r in rows]
            history = np.concatenate([np.repeat(h, _unpack(r["sizes"])) for h, r in zip(asked, rows, strict=True)])
            lower = np.concatenate([np.frombuffer(r["table"], "<f8")[_unpack(r["places"])] for r in rows])
            order = np.lexsort((word, history))
            new = np.r_[True, (word[order][1:] != word[order][:-1]) | (history[order][1:] != history[order][:-1])][: len(order)]
        else:
            order = np.argsort(word)
            new = np.r_[True, word[order][1:] != word[order][:-1]][: len(order)]
        first = np.flatnonzero(new)
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.add.reduceat(times[order], first) if len(first) else times[:0]
        seen = total > 0
        numbers = np.where(seen, np.cumsum(seen) * buckets + number + 1, 0)  # 0: never learned; 1: the start of a text
        out = []
        if level > 1:
            known, which = np.unique(np.concatenate(asked), return_inverse=True)
            of = np.searchsorted(known, history[order][first])
            follow = np.stack([np.bincount(of[total == r], minlength=len(known)) for r in range(1, CUTOFF + 1)], axis=1) if len(first) else np.zeros((len(known), CUTOFF), dtype=np.int64)
            left = np.bincount(of[seen], lower[order][first][seen], len(known)) if len(first) else np.zeros(len(known))
            asked_ends = np.cumsum([len(h) for h in asked])
        at = from_ = 0
        for k, r in enumerate(rows):
            g = group[at : ends[k]]
            at = ends[k]
            answer = [_pack(total[g]), _pack(numbers[g]) if more else None, None, None]
            if level > 1:
                h = which[from_ : asked_ends[k]]
                from_ = asked_ends[k]
                answer[2:] = [_pack(follow[h].ravel()), left[h].astype("<f8").tobytes()]
            out.append(("answer", level, number, r["chunk"], *answer, None, None, *[None] * len(_TOTALS)))
        words = word[order][first][seen]
        sums = [int(total.sum()), int(seen.sum()), *(int((total == r).sum()) for r in range(1, CUTOFF + 2))]
        out.append(("model", level, number, None, _pack(total[seen]), None, None, None, _pack(history[order][first][seen]) if level > 1 else None, words.astype("<u8").tobytes() if level == 1 else _pack(words), *sums))
        return _table(out, _ANSWER).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now and rows:
                    yield bucket(now, rows)
                    rows = []
                now = row["bucket"]
                rows.append(row)
        if rows:
            yield bucket(now, rows)

    return run


def _score(sums: list[dict], buckets: int, kind: pa.DataType):
    schema = pa.schema([("doc_id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        parts = []
        for row in chunk.to_pylist():
            r = Reader(row, answers, sums, buckets)
            total, types = sums[0]["total"], sums[0]["types"]
            c = r.word_counts[r.codes]
            base = np.log10((c + 1) / (total + types + 1))
            add = lambda x: np.add.reduceat(x, r.starts)  # noqa: E731, B023
            parts.append(pa.table([pa.array(row["ids"], kind), pa.array(~r.learn), pa.array(r.sizes), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(r.sizes), total)), pa.array(add(base)), pa.array(add(np.log10(r.p)))], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def katz_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk_tokens: int = CHUNK_TOKENS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: log10 probabilities of each text by add-one words and by the Katz model of ``order`` words, learned where ``learn`` holds."""
    if order < 1:
        raise ValueError("an n-gram has a word at least")
    spark = docs.sparkSession
    ws = Workspace(spark, "language-model")
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    whole = texts.agg(F.sum(F.octet_length("text")), F.sum(F.col("learn").cast("long"))).first()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n *= max(1, -(-int(whole[0] or 0) // (task_bytes * n)))
    buckets = 2 * n
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    name = f"mnemex_chunks_{uuid.uuid4().hex}"
    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    try:
        with passing_shuffles(spark):
            texts.mapInArrow(_chunks(arrow, chunk_tokens), _CHUNKS.format(kind.simpleString())).repartition(n, "chunk").write.option("path", ws.path("chunks")).option("compression", "zstd").bucketBy(n, "chunk").saveAsTable(name)
        chunks = spark.table(name)
        sums: list[dict] = []
        answers = spark.createDataFrame([], _ddl(_ANSWER))
        for level in range(1, order + 1):
            sent = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_ask(level, sums, buckets), _ddl(_MESSAGE))
            found = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_sum_up(level, buckets, level < order), _ddl(_ANSWER))
            with passing_shuffles(spark):
                found.write.option("compression", "zstd").partitionBy("kind").parquet(ws.path(f"level-{level}"))
            stored = spark.read.schema(_ddl(_ANSWER)).parquet(ws.path(f"level-{level}"))
            s = stored.where("kind = 'model'").agg(*(F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in _TOTALS)).first()
            sums.append({"total": s.total, "types": s.types, "n": [s[f"n{r}"] for r in range(1, CUTOFF + 2)], "documents": int(whole[1] or 0), "more": level < order})
            own = stored.where("kind = 'answer'")
            answers = own if level == 1 else answers.unionByName(own)
        scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(sums, buckets, arrow), schema)
        return ws.save(scored, "scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        ws.drop("chunks")


def op13(docs: DataFrame) -> DataFrame:
    return katz_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
