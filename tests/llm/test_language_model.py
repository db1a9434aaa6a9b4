"""The Katz model against a plain one, and that its probabilities add up to 1."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemex.llm import language_model
from tests.llm.common import TEXTS, documents, none

K = language_model.CUTOFF


class Plain:
    """Tables of n-grams as dictionaries, asked one token at a time."""

    def __init__(self, texts, order):
        self.order, self.counts, self.sums = order, [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
        for words in texts:
            for k in range(1, order + 1):
                for history, w in self.grams(words, k):
                    self.counts[k][history, w] += 1
                    self.sums[k][history] += 1
        self.d = [None] + [self.discounts(Counter(self.counts[k].values())) for k in range(1, order + 1)]
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.followers = [{} for _ in range(order + 1)]
        for k in range(2, order + 1):
            for (history, w), c in self.counts[k].items():
                self.followers[k].setdefault(history, []).append((w, c))
        self.weights = {}

    @staticmethod
    def grams(words, k):
        padded = ["<s>", *words] if k > 1 else words
        for i in range(len(padded) - k + 1):
            yield tuple(padded[i : i + k - 1]), padded[i + k - 1]

    @staticmethod
    def discounts(n):
        if n[1] and (K + 1) * n[K + 1] != n[1]:
            high = (K + 1) * n[K + 1] / n[1]
            d = [((r + 1) * n[r + 1] / (r * n[r]) - high) / (1 - high) if n[r] else 0 for r in range(1, K + 1)]
            if all(0 < x < 1 for x in d):
                return [1, *d]
        off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        return [1] + [(r - off) / r for r in range(1, K + 1)]

    def discounted(self, k, c):
        return c * (self.d[k][c] if c <= K else 1)

    def weight(self, k, history):
        if (k, history) not in self.weights:
            c, mass = self.sums[k][history], sum(n - self.discounted(k, n) for _, n in self.followers[k][history])
            c, mass = (c, mass) if mass > 0 else (c + 1, 1)
            self.weights[k, history] = c, mass / c / (1 - sum(self.p(k - 1, history[1:], w) for w, _ in self.followers[k][history]))
        return self.weights[k, history]

    def p(self, k, history, w):
        if k == 1:
            left = 1 - sum(self.discounted(1, c) for c in self.counts[1].values()) / self.n if self.n else 1
            unknown = max(left, 1 / (self.n + self.v + 1))
            c = self.counts[1][(), w]
            return self.discounted(1, c) / self.n * (1 - unknown) / (1 - left) if c else unknown
        if not self.sums[k][history]:
            return self.p(k - 1, history[1:], w)
        total, weight = self.weight(k, history)
        c = self.counts[k][history, w]
        return self.discounted(k, c) / total if c else weight * self.p(k - 1, history[1:], w)

    def score(self, words):
        padded = ["<s>", *words]
        return sum(math.log10(self.p(k := min(self.order, i + 1), tuple(padded[i - k + 1 : i]), padded[i])) for i in range(1, len(padded)))


def cut(text):
    return [*(w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").lower().split()), " "]


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        at, text = r.randrange(60), []
        for _ in range(r.randint(0, 40)):
            at = r.choice([(at * 7 + 1) % 60, (at + 1) % 60, min(r.randrange(60), r.randrange(60))])
            text.append(words[at].upper() if r.random() < 0.1 else words[at])
        out.append((100 + i, " \n".join(text)))
    return out


def wanted(rows, order):
    learned = [cut(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    m = Plain(learned, order)
    out = []
    for i, t in rows:
        w = cut(t)
        c = [m.counts[1][(), x] for x in w]
        out.append((str(i), i is None or zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(x > 0 for x in c), m.n, sum(math.log10((x + 1) / (m.n + m.v + 1)) for x in c), m.score(w)))
    return m, out


@pytest.mark.parametrize(("order", "options"), [(1, {}), (2, {}), (2, {"chunk_tokens": 50, "task_bytes": 2000}), (3, {"chunk_tokens": 300}), (4, {"chunk_tokens": 2000})])
def test_scores_against_a_plain_model(spark, order, options):
    rows = corpus(order, 250) + TEXTS
    model, want = wanted(rows, order)
    df = documents(spark, rows).repartition(3)
    got = language_model.katz_scores(df, F.crc32(F.col("doc_id").cast("string")) % 7 != 2, order=order, **options).collect()
    got = sorted((str(r.doc_id), *r[1:]) for r in got)
    assert [x[:5] for x in got] == [x[:5] for x in sorted(want)]
    assert [x[5:] for x in got] == [pytest.approx(x[5:], rel=1e-9) for x in sorted(want)]
    vocabulary = [w for _, w in model.counts[1]] + ["<unknown>"]
    histories = [h for k in range(2, order + 1) for h in model.followers[k]][:200] + [("nothing",) * (order - 1)]
    for h in histories[:: max(1, len(histories) // 40)]:
        assert sum(model.p(len(h) + 1, h, w) for w in vocabulary) == pytest.approx(1, rel=1e-9)


def test_odd_corpora(spark):
    assert language_model.op13(none(spark)).count() == 0
    for rows in ([(1, "a a a b"), (1, "a a a b"), (None, "a c")], [(i, "x " * 9) for i in range(30)], [(i, None) for i in range(9)], [(None, "a b")]):
        got = sorted((str(r.doc_id), *r[1:]) for r in language_model.op13(documents(spark, rows)).collect())
        assert got == [tuple(pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for v in x) for x in sorted(wanted(rows, 2)[1])]
    with pytest.raises(ValueError):
        language_model.katz_scores(none(spark), F.lit(True), order=0)


def test_discounts():
    assert language_model.discounts([0, 0, 0, 0, 0, 0])[1:].tolist() == [(r - 0.5) / r for r in range(1, K + 1)]
    good = language_model.discounts([1000, 400, 220, 140, 95, 70])
    assert good[0] == 1 and all(0 < a < 1 for a in good[1:])
    high = 6 * 70 / 1000
    assert good[1] == pytest.approx((2 * 400 / 1000 - high) / (1 - high))


def test_histories_with_many_shares_and_stored_tables(spark, sf, tmp_path):
    """A third of all words are one word; its history is spread over buckets and scores stay those of the plain model."""
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the", "the", f"u{r.randrange(400)}"]) for _ in range(60))) for i in range(200)]
    want = sorted(wanted(rows, 3)[1])
    got = sorted((str(x.doc_id), *x[1:]) for x in language_model.katz_scores(documents(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 7 != 2, order=3, chunk_tokens=500, task_bytes=4000).collect())
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [x[5:] for x in got] == [pytest.approx(x[5:], rel=1e-9) for x in want]


def test_held_out_texts_are_likelier_than_by_words(spark, sf):
    got = language_model.op13(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]
