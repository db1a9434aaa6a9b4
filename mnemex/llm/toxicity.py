"""Toxicity by multiple-instance learning: sentences are instances, a document is a bag.

A sentence scores sigmoid(bias + sum of its words' weights); a word has the weights of its hash and of the hashes of its first four, five and six
characters, so inflected forms of one stem share what was learnt. A document is toxic if any
sentence is: noisy-or, 1 - prod(1 - p). The weights are fitted to document labels through the noisy-or, so the
gradient reaches the sentences that carry the label, which are then located by their own scores. The odds of a sentence fall with the number of sentences of its text (``spread``), in the fit and in scores alike: thousands of
faint sentences, in a long clean text, are no more evidence than a few.

The model is fitted on a bounded sample of labelled rows: the ``sample_rows`` smallest hashes of the id
(8,000 by default), whole texts. Features that few of them hold, or that don't stand in toxic ones notably more often than in others, have no weight: they are counted first, as a table, and
dropped where the texts are read. Equal sentences of a text
travel once with their count; scoring reads whole texts of all documents in one map, with no shuffle.

Defined results: null and empty texts have no sentence and score 0; without labels of both kinds every score is next to 0 (under 1e-9);
several labels of one id count as the highest; equal rows score alike, whatever stands beside them; null ids are scored, and are not held out; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Workspace

BITS = 20
STEMS = (4, 5, 6)
THRESHOLD = 0.3
SAMPLE_ROWS = 8_000
LEAST, LIFT, PRIOR = 5, 0.5, 2.0
CACHE = 150_000
RUN = 40
TYPICAL = 8  # sentences
SENTENCE_END = re.compile(r"[.!?\n…。！？]+")
TRIM = "\"'`,;:()[]{}<>|*#$%&_-“”‘’«»¿¡"


def number(part: str) -> int:
    return 1 + (crc32(part.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1))


def stems(bare: str) -> tuple[int, ...]:
    return tuple(number("^" + bare[:n]) for n in STEMS if len(bare) > n)


def features(word: str) -> tuple[int, ...]:
    """Numbers of the weights of a word, from 1 on; none for words that are punctuation only."""
    bare = word.strip(TRIM)
    return (number(bare), *stems(bare)) if bare else ()


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence; what runs on without an end is cut every ``RUN`` words, or many faint words would add up."""
    parts = [words for part in SENTENCE_END.split((text or "").lower()) if (words := part.split())]
    return [words[i : i + RUN] for words in parts for i in range(0, len(words), RUN)]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def spread(n):
    """What a sentence's log odds lose in a text of ``n`` sentences: the odds that some sentence of a text is toxic are shared out, so faint sentences don't add up with the length of a text. Texts up to ``TYPICAL`` sentences lose nothing."""
    return np.log(np.maximum(1.0, np.asarray(n, dtype=float) / TYPICAL))


def combined(own: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Noisy-or of the sentence scores of each of ``n`` documents; ``own`` is the document of each."""
    return np.clip(-np.expm1(np.bincount(own, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)), 0.0, 1.0)


@dataclass
class Model:
    bias: float
    weights: dict[int, float]  # by feature; others weigh nothing

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def run_score(self, words: list[str], n: int) -> float:
        """Of one sentence of a text of ``n``."""
        return float(sigmoid(self.bias - spread(n) + sum(map(self.word, words))))

    def sentence_scores(self, text: str | None) -> list[float]:
        every = sentences(text)
        return [self.run_score(words, len(every)) for words in every]

    def score(self, text: str | None) -> float:
        p = np.array(self.sentence_scores(text))
        return float(combined(np.zeros(len(p), dtype=np.int64), p, 1)[0])

    def locate(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, int, float]]:
        """(number, start, end, score) of the sentences that score ``threshold`` or more alone; code points, end exclusive."""
        text, at, k, out = text or "", 0, 0, []
        n = len(sentences(text))
        for stop, after in [*(m.span() for m in SENTENCE_END.finditer(text)), (len(text), len(text))]:
            words = text[at:stop].lower().split()
            if words:
                p = max(self.run_score(words[j : j + RUN], n) for j in range(0, len(words), RUN))
                if p >= threshold:
                    out.append((k, at, stop, p))
                k += 1
            at = after
        return out


def fit(bags: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], epochs: int = 40, rate: float = 2.0, least: int = LEAST, prior: float = PRIOR, seed: int = 7) -> Model:
    """``bags``: label, features, the sentence of each feature (ascending, from 0), and how often each sentence stands.

    Features in fewer than ``least`` documents keep weight 0: a rare word of a toxic document would
    explain it alone. The others start from shrunken log odds of the documents that hold
    them, where positive, and are then moved down the gradient of the noisy-or likelihood.
    """
    bags = [b for b in bags if len(b[3])]
    n_toxic = sum(b[0] for b in bags)
    if not 0 < n_toxic < len(bags):
        return Model(-30.0, {})
    place = np.zeros(2 + (1 << BITS), dtype=np.int32)
    for b in bags:
        place[b[1]] = 1
    names = np.flatnonzero(place)
    place[names] = np.arange(len(names))
    bags = [(y, place[words], sents, times) for y, words, sents, times in bags]
    weights, bias = np.zeros(len(names)), -7.0
    seen, toxic = np.zeros_like(weights), np.zeros_like(weights)
    for y, words, *_ in bags:
        seen[(own := np.unique(words))] += 1
        toxic[own] += y
    base = n_toxic / len(bags)
    odds = np.log((toxic + prior * base) / (seen - toxic + prior * (1 - base))) - np.log(base / (1 - base))
    use = seen >= least
    weights[use] = np.maximum(odds[use] - 1.0, 0.0) * 1.5
    pace, step = np.zeros_like(weights), 0.0
    order = np.random.default_rng(seed)
    for epoch in range(epochs):
        for part in np.array_split(order.permutation(len(bags)), max(1, len(bags) // 512)):
            y = np.array([bags[i][0] for i in part], dtype=float)
            n_sent = np.array([len(bags[i][3]) for i in part])
            first = np.r_[0, np.cumsum(n_sent)[:-1]]
            words = np.concatenate([bags[i][1] for i in part])
            sent = np.concatenate([bags[i][2] + s for i, s in zip(part, first, strict=True)])
            times = np.concatenate([bags[i][3] for i in part])
            size = np.repeat(np.add.reduceat(times, first), n_sent)
            p = sigmoid(bias - spread(size) + np.bincount(sent, weights[words], minlength=n_sent.sum()))
            quiet = np.add.reduceat(times * np.log1p(-np.minimum(p, 1 - 1e-12)), first)  # log of no toxic sentence
            bag = np.clip(-np.expm1(quiet), 1e-3, 1 - 1e-9)  # the floor keeps unexplained labels from ruling
            # d loss / d z of a sentence: p for clean documents, -p (1 - bag) / bag for toxic ones
            gz = times * p * np.repeat(np.where(y == 1, -(1 - bag) / bag, 1.0), n_sent) / len(part)
            gw = np.bincount(words, gz[sent], minlength=len(weights)) * use
            pace = 0.9 * pace + gw
            step = 0.9 * step + gz.sum()
            weights -= rate / (1 + epoch / 10) * 0.3 * pace
            bias -= rate / (1 + epoch / 10) * 0.1 * step
    known = np.flatnonzero(weights)
    return Model(float(bias), dict(zip(names[known].tolist(), weights[known].astype(np.float32).tolist(), strict=True)))


def bag_of(text: str | None, used=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, their sentences, and how often each different sentence stands; of the features only those in ``used``."""
    known: dict[str, tuple[int, ...]] = {}

    def of(word: str) -> tuple[int, ...]:
        if (got := known.get(word)) is None:
            got = known[word] = tuple(f for f in features(word) if used is None or used[f])
        return got

    times = Counter(tuple(f for w in words for f in of(w)) for words in sentences(text))
    flat = np.array([f for own in times for f in own], dtype="<i4")
    return flat, np.repeat(np.arange(len(times), dtype="<i4"), [len(own) for own in times]), np.array(list(times.values()), dtype="<i4")


def _held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts, and how many toxic ones, hold each feature."""
    for batch in batches:
        for y in (0, 1):
            own = batch.filter(pc.equal(batch.column(0), y)).column(1)
            found = [np.unique(bag_of(x.as_py())[0]) for x in own]
            names, n = np.unique(np.concatenate([np.zeros(0, "<i4"), *found]), return_counts=True)
            yield pa.record_batch({"feature": pa.array(names, pa.int32()), "n": pa.array(n, pa.int64()), "toxic": pa.array(n * y, pa.int64())})


def _featurise(used: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(used)
        for batch in batches:
            bags = [[x.tobytes() for x in bag_of(x.as_py(), table)] for x in batch.column(1)]
            columns = list(zip(*bags, strict=True)) if bags else [[]] * 3
            yield pa.record_batch({"y": batch.column(0), **{n: pa.array(c, pa.binary()) for n, c in zip(("words", "sents", "times"), columns, strict=True)}})

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on the labels of ids whose crc32 (of the id as text) isn't 2 modulo 4."""
    ws = Workspace(docs.sparkSession, "toxicity")
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y"))
    usable = marks.where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i")))
    sample = usable.groupBy("i").agg(F.max("y").cast("int").alias("y")).orderBy(F.xxhash64("i"), "i").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), "i").groupBy("i", "y").agg(F.min("text").alias("text"))  # an id may have several texts
    rows = ws.save(rows.select("y", "text"), "sample")
    n, toxic = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or not 0 < toxic < n:
        return Model(-30.0, {})
    held = rows.mapInArrow(_held_by, "feature int, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= LEAST)
    share = toxic / n
    odds = (F.col("toxic") + PRIOR * share) / (F.col("n") - F.col("toxic") + PRIOR * (1 - share))
    used = np.zeros(8 + (1 << BITS), dtype=np.uint8)
    used[held.where(F.log(odds * (1 - share) / share) > LIFT).select("feature").toArrow().column(0).to_numpy()] = 1  # no more than 2 ** BITS
    found = rows.mapInArrow(_featurise(np.packbits(used)), "y int, words binary, sents binary, times binary").collect()  # at most sample_rows rows
    found.sort(key=lambda r: (r.y, bytes(r.words), bytes(r.times)))
    return fit([(r.y, *(np.frombuffer(x, "<i4") for x in (r.words, r.sents, r.times))) for r in found])


def held_out(id_column):
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Scorer(dict):
    """Scores of texts; holds the weights of at most ``CACHE`` words, and of as many stems."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.stems = model, {}

    def stem(self, start: str) -> float:
        """What the first characters of a word add; seven tell which of them are all there is."""
        if len(self.stems) >= CACHE:
            self.stems.clear()
        value = self.stems[start] = sum(self.model.weights.get(f, 0.0) for f in stems(start))
        return value

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        bare = word.strip(TRIM)
        value = 0.0
        if bare:
            start = bare[: STEMS[-1] + 1]
            value = self.stems.get(start)
            value = self.model.weights.get(number(bare), 0.0) + (self.stem(start) if value is None else value)
        self[word] = value
        return value

    def scores(self, texts: pa.Array) -> np.ndarray:
        z, own = [], []
        for k, x in enumerate(texts):
            if text := x.as_py():
                got = [sum(map(self.__getitem__, words)) for words in sentences(text)]
                z += got
                own += [k] * len(got)
        own = np.array(own, dtype=np.int64)
        return combined(own, sigmoid(np.array(z, dtype=float) + self.model.bias - spread(np.bincount(own, minlength=len(texts)))[own]), len(texts))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and ``located``: start:end of the sentences that score ``threshold`` alone, of documents that do, joined by commas."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            marks = scorer.scores(batch.column(1))
            places = [",".join(f"{a}:{b}" for _, a, b, _ in model.locate(batch.column(1)[k].as_py(), threshold)) if m >= threshold else "" for k, m in enumerate(marks)]
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(marks), "located": pa.array(places, pa.string())})

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, located string")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "located")


def locate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, sentence, start, end, score``: the sentences that score ``threshold`` or more alone (code points, end exclusive)."""

    def run(batches):
        for batch in batches:
            rows = [(i.as_py(), *got) for i, x in zip(batch.column(0), batch.column(1), strict=True) for got in model.locate(x.as_py(), threshold)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "sentence", "start", "end", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, sentence long, start long, end long, score double")


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more, all columns and row order of a map kept."""
    model = train(docs, labels, id_col, text_col)

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            marks = scorer.scores(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array(marks < threshold))

    return docs.mapInArrow(run, docs.schema)


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
