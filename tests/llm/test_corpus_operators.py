"""Filters, near-duplicates, repeats, toxicity, quality and the pipeline: against brute force."""

import hashlib
import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from mnemex.llm import decontaminate, pii, quality, simhash, substring_dedup, toxicity, url_filter
from tests.llm.common import LONG, TEXTS, documents, none
from tests.llm.test_near_copies import plain_components


def test_url_rules(spark):
    urls = [
        "http://a.net/x", "HTTP://A.NET", "https://www.Example.net/en/25#top", "https://example.net/de/1", "x://m.example.com/de/a?b", "http://example.com/fr/", "http://b.org/fr/", "http://net/", None, "nothing", "http://evilexample.net/en/",
        "http://a.b.c.d.e.f.net/" + "y/" * 3000, "http://" + "l." * 3000 + "org/fr/z", "", "http://a.net:80/x",
    ]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(0, urls[0], "clash", "clash")], "page_id long, url string, host string, rule string")
    rules = url_filter.rule_table(spark, url_filter.RULES)

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, "allow")))

    wanted = sorted(map(repr, [(i, *plain(u)) for i, u in enumerate(urls)] + [(0, *plain(urls[0]))]))
    for few in (10, 0):  # by broadcast and by shuffle
        got = url_filter.judge_urls(pages, rules, broadcast_rules=few).collect()
        assert sorted(map(repr, map(tuple, got))) == wanted
    odd = spark.createDataFrame([("a.com", "/x", "block"), ("a.com", "/x", "allow"), ("a.com", "/xy", "allow"), ("com", "", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = url_filter.judge_urls(spark.createDataFrame([(1, "q://a.com/xyz"), (2, "q://a.com/xz"), (3, "q://b.com")], "page_id long, url string"), odd)
    assert {(r.page_id, r.rule, r.verdict) for r in got.collect()} == {(1, "a.com/xy", "allow"), (2, "a.com/x", "block"), (3, "com", "block")}
    assert url_filter.op1(pages.where("false")).count() == 0
    assert url_filter.judge_urls(pages, rules.where("false")).where("verdict = 'allow'").count() == len(urls) + 1


def components(rows, limit=4):
    fps = [simhash.fingerprint(t) for _, t in rows]
    low = {i: i for i in range(len(rows))}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                low[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return sorted((str(rows[i][0]), f"{fps[i]:016x}", min((d for d in ids[find(i)] if d is not None), default=None)) for i in range(len(rows)))


def plain_fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_those_of_the_contract():
    r = random.Random(6)
    texts = [t for _, t in TEXTS] + ["A b\x0bC\x0cd\re f", "É É é é É x", "one two three", "a\xa0b c\u2003d e f g"]
    texts += [" ".join(r.choice(["Aa", "b", "ß", "é", "c,"]) for _ in range(r.randint(0, 30))) for _ in range(100)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize(("crowd", "limit"), [(2000, 4), (2, 4), (2, 3), (2000, 2), (2, 2), (2, 1), (2, 0)])
def test_simhash_links_all_that_are_near(spark, crowd, limit):
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefghijklmnopqrst") * r.randint(1, 3) for _ in range(80)) for _ in range(12)]
    rows = list(TEXTS)
    for i in range(120):
        words = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(80)] = r.choice(["x", "y", "zz"])
        rows.append((100 + i, " ".join(words)))
    got = simhash.simhash_groups(documents(spark, rows), limit=limit, bucket_rows=crowd).withColumn("h", F.lpad(F.lower(F.hex("fp")), 16, "0"))
    assert sorted((str(x.doc_id), x.h, x.component_id) for x in got.collect()) == components(rows, limit)


def test_anchors_cover():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, size=200, dtype=np.uint64)
    for wrong in range(5):
        y = x.copy()
        for i in range(len(y)):
            for b in r.choice(64, wrong, replace=False):
                y[i] ^= np.uint64(1 << int(b))
        (ka, ra), (kb, rb) = simhash.anchors(x), simhash.anchors(y)
        a, b = set(zip(ra.tolist(), ka.tolist(), strict=True)), set(zip(rb.tolist(), kb.tolist(), strict=True))
        assert {i for i, _ in a & b} == set(range(200))


def test_near_dedup_keeps_one(spark):
    rows = [(3, LONG), (1, LONG), (2, LONG + "x"), (4, "other words here that are not alike at all"), (4, "other words here that are not alike at all"), (None, "a"), (None, "a")]
    got = simhash.near_dedup(documents(spark, rows))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "4", "None", "None"]
    odd = documents(spark, rows).withColumnRenamed("fp", "_head_id").withColumnRenamed("low", "_head_hash").withColumnRenamed("key", "hash").withColumnRenamed("uid", "id")
    assert sorted(str(r.doc_id) for r in simhash.near_dedup(odd).collect()) == ["1", "4", "None", "None"]
    assert got.columns == documents(spark).columns and simhash.near_dedup(none(spark)).count() == 0
    assert simhash.op6(none(spark)).count() == 0


def plain_overlaps(rows, items):
    """All diagonals of all pairs, word by word."""

    def words(text):
        return [w for raw in (text or "").split() if (w := "".join(c for c in raw.lower() if c.isalnum()))]

    out = set()
    for i, t in rows:
        w = words(t)
        for item, x in items:
            own = words(x)
            need = min(12, len(own))
            wanted = 10 if need == 12 else -(-8 * need // 10)
            best = None
            for first in range(1 - len(own), len(w)) if len(own) >= 5 else []:
                lo, hi = max(0, -first), min(len(own), len(w) - first)
                good = [k for k in range(lo, hi - need + 1) if sum(own[j] == w[first + j] for j in range(k, k + need)) >= wanted]
                if good:
                    a, b = good[0], good[-1] + need
                    got = (first + a, b - a, sum(own[j] == w[first + j] for j in range(a, b)))
                    if best is None or got[1] > best[1]:
                        best = got
            if best:
                out.add((i, item, *best))
    return out


def test_decontamination_finds_all_substituted_passages(spark):
    assert decontaminate.masks() == decontaminate.MASKS
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 5)))
    items = [(k, " ".join(word() for _ in range(r.randint(12, 30)))) for k in range(12)] + [(20 + n, " ".join(word() for _ in range(n))) for n in range(3, 12)]
    items += [(40, "ha " * 15), (41, "ha ho " * 7)]
    rows = [(200, "ha " * 30), (201, "ho ha " * 9 + "x"), (202, "ha " * 13)]
    for i in range(90):
        words = [word() for _ in range(r.randint(0, 60))]
        own = r.choice(items)[1].split()
        for k in range(len(own)):
            if r.random() < 0.12:
                own[k] = "zz"
        at = r.randint(0, len(words))
        rows.append((i, " ".join(words[:at] + own[r.randint(0, 6) if len(own) > 11 else 0 :] + words[at:])))
    bench = spark.createDataFrame([*items, (None, "x"), (90, None), (91, "too short")], "item_id long, text string")
    wanted = plain_overlaps(rows, items)
    assert {item for _, item, *_ in wanted} > {20 + n for n in range(5, 12)} | {40, 41}
    for most in (1 << 27, 1 << 9):  # a table that decides, and one that lets nearly all through
        got = decontaminate.overlaps(documents(spark, rows + TEXTS), bench, filter_bits=most)
        assert sorted(map(tuple, got.collect())) == sorted(wanted)
    dirty = {i for i, *_ in wanted}
    odd = documents(spark, rows + TEXTS).withColumnRenamed("fp", "_dirty_text").withColumnRenamed("low", "words")
    clean = decontaminate.remove_contaminated(odd, bench)
    assert clean.columns == odd.columns and sorted(str(x.doc_id) for x in clean.collect()) == sorted(str(i) for i, _ in rows + TEXTS if i not in dirty or (i, _) in TEXTS)
    assert decontaminate.op4(none(spark), bench).count() == 0 and decontaminate.op4(documents(spark), bench.where("false")).count() == 0
    assert decontaminate.remove_contaminated(documents(spark), bench.where("false")).count() == len(TEXTS)


def test_masks_of_short_items_miss_nothing():
    for n in range(5, 12):
        for gone in combinations(range(n), n - decontaminate.least_alike(n)):
            assert any(not {p + s for p in m} & set(gone) for m in decontaminate.masks_for(n) for s in range(n - m[-1])), (n, gone)


def test_repeated_words_take_little(spark):
    import tracemalloc

    w, own = np.full(50_000, 7, dtype=np.uint64), np.full(3000, 7, dtype=np.uint64)
    tracemalloc.start()
    found = decontaminate.diagonals([(np.arange(49_990), np.arange(2990))])
    assert decontaminate.longest(w, own, found) == (0, 3000, 3000)
    own[::4] = 8  # no stretch is long enough, so every diagonal is looked at
    assert decontaminate.longest(w, own, found[:2000]) is None
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()
    bench = spark.createDataFrame([(1, "ha " * 3000)], "item_id long, text string")
    got = decontaminate.op4(documents(spark, [(5, "ha " * 50_000), (5, "ha " * 50_000), (6, "ha " * 11)]), bench).collect()
    assert [tuple(x) for x in got] == [(5, 1, 0, 3000, 3000)] * 2


def plain_removal(rows):
    last = 1 << 63
    seen, out = {}, []
    texts = [(last if i is None else i, (t or "").encode(), i) for i, t in rows]
    for d, b, _ in texts:
        for a in range(len(b) - 49):
            seen[b[a : a + 50]] = min(d, seen.get(b[a : a + 50], last))
    for d, b, i in texts:
        gone = bytearray(len(b))
        for a in range(len(b) - 49):
            if seen[b[a : a + 50]] < d:
                gone[a : a + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((str(i), len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"crowd": 2}, {"shard_bytes": 500}, {"task_bytes": 2000}])
def test_substrings_against_brute_force(spark, options):
    r = random.Random(7)
    rows = [(i, t[:3000] if t else t) for i, t in TEXTS]
    shared = ["".join(r.choice("abcdé \n") for _ in range(n)) for n in (49, 50, 51, 120, 300)]
    for i in range(40):
        rows.append((100 + i, "".join("".join(r.choice("abcdé \n") for _ in range(r.randint(0, 90))) + r.choice(shared) for _ in range(r.randint(0, 4)))))
    got = substring_dedup.removed_spans(documents(spark, rows), **options).drop("runs")
    assert sorted((str(x.doc_id), *x[1:]) for x in got.collect()) == plain_removal(rows)
    assert substring_dedup.op8(none(spark)).count() == 0


def test_substrings_of_long_texts_in_small_runs(spark, monkeypatch):
    r = random.Random(8)
    texts = ["".join(r.choice("abc ") for _ in range(n)) for n in (40, 50, 130, 400, 900)]
    texts += [texts[4][100:700], texts[3] + texts[4], "x" * 700, "x" * 60 + texts[2], texts[2] + texts[2], "ab" * 200, "ba" * 90]
    rows = list(enumerate(r.sample(texts, len(texts))))
    monkeypatch.setattr(substring_dedup, "RUN", 128)
    substring_dedup._powers.cache_clear()
    offsets = np.cumsum([0, *(len(t) for _, t in rows)])
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    windows: dict[str, set[int]] = {}
    seen = []
    for row, first, last, g, _ in substring_dedup.regions(data, offsets):
        for k, a, b, h in zip(row.tolist(), first.tolist(), last.tolist(), g.tolist(), strict=True):
            for at in range(a, b + 1):
                windows.setdefault(rows[k][1][at - offsets[k] :][:50], set()).add(h)
                seen.append(at)
    assert all(len(w) == 50 and len(h) == 1 for w, h in windows.items())  # an anchor is a function of its window
    assert sorted(seen) == [at for k in range(len(rows)) for at in range(offsets[k], offsets[k + 1] - 49)]
    monkeypatch.undo()
    substring_dedup._powers.cache_clear()
    long = [(i, t * 700) for i, t in rows if len(t) > 300][:4] + rows
    got = substring_dedup.removed_spans(documents(spark, long)).drop("runs")
    assert sorted((str(x.doc_id), *x[1:]) for x in got.collect()) == plain_removal(long)
    with pytest.raises(TypeError):
        substring_dedup.op8(documents(spark, rows).withColumn("doc_id", F.col("doc_id").cast("string")))


def test_substrings_of_periodic_texts(spark):
    """Texts of every period from 1 to 49 and of a repeated word, over many blocks and batches: ties between equal grams fall alike wherever a text lies."""
    r = random.Random(10)
    rows = []
    for period in range(1, 50):
        word = "".join(r.choice("abcdef ") for _ in range(period))
        rows += [("".join(r.choice("xyz") for _ in range(r.randint(0, 70))) + word * (r.randint(60, 300) // period + 2) + "".join(r.choice("xyz") for _ in range(r.randint(0, 70)))) for _ in range(3)]
    rows += ["abcde " * n + "".join(r.choice("uvw") for _ in range(r.randint(0, 40))) for n in range(11, 41)]
    rows = list(enumerate(r.sample(rows, len(rows))))
    got = substring_dedup.removed_spans(documents(spark, rows).repartition(7)).drop("runs")
    assert sorted((str(x.doc_id), *x[1:]) for x in got.collect()) == plain_removal(rows)


def test_regions_do_not_depend_on_the_place_of_a_text():
    r = random.Random(11)
    texts = [("abcde " * 40).encode(), b"x" * 300, "".join(r.choice("ab") for _ in range(500)).encode()]
    for text in texts:
        found = set()
        for before in (0, 1, 33, 64, 70):
            data = np.frombuffer(b"q" * before + text, np.uint8)
            offsets = np.array([0, before, len(data)])
            found.add(repr([(x - before, y - before, g, d) for k, f, l, gs, ds in substring_dedup.regions(data, offsets) for row, x, y, g, d in zip(k.tolist(), f.tolist(), l.tolist(), gs.tolist(), ds.tolist(), strict=True) if row == 1]))
        assert len(found) == 1


def test_interleave_gives_the_blocks_of_sorted_suffixes():
    r = random.Random(9)
    for _ in range(30):
        texts = ["".join(r.choice("ab") for _ in range(r.randint(50, 84))).encode() for _ in range(r.randint(1, 8))]
        lows = np.array([r.randint(0, 4) for _ in texts])
        text, place, least = substring_dedup.repeated(texts, lows, shard_bytes=100)
        wanted = {}
        for x, low in zip(texts, lows, strict=True):
            for i in range(len(x) - 49):
                wanted[x[i : i + 50]] = min(low, wanted.get(x[i : i + 50], 99))
        assert len(text) == sum(len(x) - 49 for x in texts)
        assert all(wanted[texts[t][p : p + 50]] == v for t, p, v in zip(text, place, least, strict=True))


def test_fit_is_that_of_the_plain_formula():
    """One step over all bags, against the gradient of the noisy-or likelihood taken by differences."""
    r = np.random.default_rng(3)
    bags = []
    for k in range(40):
        sizes = r.integers(0, 5, r.integers(1, 6))
        bags.append((k % 4 == 0, r.integers(1, 12, sizes.sum()).astype("<i4"), np.repeat(np.arange(len(sizes)), sizes).astype("<i4"), r.integers(1, 6, len(sizes)).astype("<i4")))

    def loss(weights, bias):
        total = 0.0
        for y, words, sents, times in bags:
            off = np.log(max(1, sum(times) / toxicity.TYPICAL))
            p = [1 / (1 + np.exp(-(bias - off + sum(weights[w] for w, s in zip(words, sents, strict=True) if s == k)))) for k in range(len(times))]
            bag = 1 - np.prod([(1 - x) ** n for x, n in zip(p, times, strict=True)])
            total -= np.log(bag) if y else np.log(1 - bag)
        return total / len(bags)

    start = toxicity.fit(bags, epochs=0, least=1)
    after = toxicity.fit(bags, epochs=1, rate=1e-3, least=1)
    weights = np.zeros(13)
    for f, v in start.weights.items():
        weights[f] = v
    for f in range(1, 12):
        up, down = weights.copy(), weights.copy()
        up[f] += 1e-5
        down[f] -= 1e-5
        slope = (loss(up, start.bias) - loss(down, start.bias)) / 2e-5
        if slope:
            assert after.weights.get(f, 0.0) - start.weights.get(f, 0.0) == pytest.approx(-3e-4 * slope, rel=0.1, abs=1e-7)


def test_held_out_recall_by_language(spark, sf):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.op9(docs, labels).where("held_out").join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    table = {(x.lang, x.toxic): (x.n, x.hit) for x in got.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("hit")).collect()}
    found, n = (sum(v[k] for (_, t), v in table.items() if t == 1) for k in (1, 0))
    wrong, clean = (sum(v[k] for (_, t), v in table.items() if t == 0) for k in (1, 0))
    assert found / n >= 0.9 and wrong / clean < 0.01, table
    assert all(hit / n >= 0.9 for (_, t), (n, hit) in table.items() if t == 1), table


def test_faint_sentences_are_no_evidence():
    model = toxicity.Model(-6.0, {toxicity.features("faint")[0]: 1.0, toxicity.features("idiot")[0]: 14.0})
    assert model.score("faint. " * 100) == pytest.approx(model.score("faint. " * 100_000), abs=0.002) and model.score("faint. " * 100_000) < 0.06
    assert model.score("faint. " * 1000 + "an idiot.") > 0.9 and 0 < model.score("word.") < model.score("faint.") < 0.01


def test_scores_are_the_noisy_or():
    """Against the formula, sentence by sentence."""
    r = random.Random(12)
    weight = {"idiot": 4.0, "scum": 6.5, "mild": 0.7}
    model = toxicity.Model(-5.0, {toxicity.features(w)[0]: v for w, v in weight.items()})
    import pyarrow as pa

    for _ in range(40):
        lines = [[r.choice(["idiot", "scum", "mild", "and", "the", "of"]) for _ in range(r.randint(1, 12))] for _ in range(r.randint(1, 60))]
        off = np.log(max(1, len(lines) / toxicity.TYPICAL))
        quiet = np.prod([1 - 1 / (1 + np.exp(-(-5.0 - off + sum(weight.get(w, 0) for w in line)))) for line in lines])
        text = ". ".join(" ".join(line) for line in lines)
        assert model.score(text) == pytest.approx(1 - quiet, abs=1e-9) and toxicity.Scorer(model).scores(pa.array([text]))[0] == pytest.approx(1 - quiet, abs=1e-9)


def test_scores_do_not_depend_on_neighbours():
    r = random.Random(2)
    texts = [" ".join(r.choice(["idiot", "a", "b", "c."]) for _ in range(r.randint(0, 80))) for _ in range(50)]
    model = toxicity.Model(-5.0, {toxicity.features("idiot")[0]: 1.37, toxicity.features("a")[0]: 0.213})
    import pyarrow as pa

    every = toxicity.Scorer(model).scores(pa.array(texts))
    assert [toxicity.Scorer(model).scores(pa.array([t]))[0] for t in texts] == every.tolist()
    odd = ["abcdef-ghi", "--abcdefg", "abcd", "abcde.", "x", "---", "abcdefghijkl", "abcdéfgh", ""]
    model = toxicity.Model(-1.0, {f: 0.01 * k for k, f in enumerate({f for w in odd for f in toxicity.features(w)}, 1)})
    assert [toxicity.Scorer(model)[w] for w in odd] == pytest.approx([model.word(w) for w in odd])


def test_toxicity_learns_and_locates(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(r.choice("lorem ipsum dolor sit amet elit sed eiusmod tempor".split()) for _ in range(8)) for _ in range(6)]
        toxic = i % 6 == 0
        if toxic:
            sentences[r.randrange(6)] += r.choice([" idiot", " scum"])
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, 1, int(toxic)))
    docs = documents(spark, rows + [(1000 + (i or 0), t) for i, t in TEXTS])
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert len(held) > 80 and all(got[i].predicted == (i % 6 == 0) for i in held)
    assert got[1002].score == 0 and got[1003].score == 0 and all(0 <= x.score <= 1 for x in got.values())
    assert abs(got[0].score - model.score(rows[0][1])) < 1e-6
    text = dict(rows)
    assert all(any(w in rows[i][1][int(a) : int(b)] for w in ("idiot", "scum")) for i in held if got[i].located for a, b in [got[i].located.split(",")[0].split(":")])
    assert toxicity.reject_toxic(docs.withColumnRenamed("fp", "_id").withColumnRenamed("low", "_y").withColumnRenamed("words", "y"), marks).count() == toxicity.reject_toxic(docs, marks).count()
    for x in toxicity.locate(docs, model).where("doc_id < 600").collect():
        assert any(w in text[x.doc_id][x.start : x.end] for w in ("idiot", "scum"))
    kept = {x.doc_id for x in toxicity.reject_toxic(docs, marks).collect()}
    assert {i for i in range(600) if i % 6} <= kept and not {i for i in range(600) if i % 6 == 0} & kept
    assert toxicity.op9(none(spark), marks).count() == 0
    assert toxicity.op9(docs, marks.where("false")).where("score > 1e-9").count() == 0


def plain_quality(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for p in windows.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality(spark):
    rows = [*TEXTS, (30, "# a *b* <c>\nx y\nx y\n\n \nx y z"), (31, "one two three four five six one two three four five six seven"), (32, "a b c d e " * 9)]
    got = quality.features(documents(spark, rows), "doc_id", "text", "source").drop("host", "n_lines").collect()
    assert sorted(map(str, (tuple(x) for x in got))) == sorted(str((i, *plain_quality(t))) for i, t in rows)
    assert quality.op10(none(spark)).count() == 0


def plain_hosts(rows):
    """Hosts that some rule fails: counts, then the beta prior by moments."""
    tables = {}
    for _, text, host in rows:
        n, chars, symbols, dup, _, base = plain_quality(text)
        lines = sum(1 for x in (text or "").split("\n") if x.strip("\t\n\x0b\x0c\r "))
        marks = {"base": base, "lines": n and 10 * dup > 3 * lines, "symbols": n and 10 * symbols > chars, "lengths": n and not 2 * n <= chars <= 20 * n}
        for rule, mark in marks.items():
            if host is not None:
                own = tables.setdefault(rule, {}).setdefault(host, [0, 0])
                own[0] += 1
                own[1] += bool(mark)
    out = {}
    for rule, hosts in tables.items():
        n = sum(a for a, _ in hosts.values())
        mean = sum(x for _, x in hosts.values()) / n
        spread = sum(a * (x / a - mean) ** 2 for a, x in hosts.values())
        room = n - sum(a * a for a, _ in hosts.values()) / n
        between = (spread - (len(hosts) - 1) * mean * (1 - mean)) / room if room else 0
        strength = min(max(mean * (1 - mean) / between - 1, 2), 1e6) if between > 0 else 1e6
        for host, (a, x) in hosts.items():
            if (x + mean * strength) / (a + strength) > 0.5:
                out.setdefault(host, rule)
    return out


def test_quality_of_hosts(spark):
    good = " ".join(f"w{k}" for k in range(30))
    kinds = {"short.com": "bad", "lines.com": "\n".join([good] + ["the same line here"] * 2), "symbols.com": " ".join(f"w{k}##" for k in range(30)), "long.com": " ".join("x" * 30 + str(k) for k in range(12))}
    rows = [(1000 * k + i, t if i % 10 else good, host) for k, (host, t) in enumerate(kinds.items()) for i in range(40)]
    rows += [(9000 + i, good, "good.com") for i in range(400)] + [(9500 + i, list(kinds.values())[i % 4] if i % 10 == 0 else good, f"mixed{i % 7}.com") for i in range(140)]
    rows += [(9800, good, None), (9801, "bad", None), (9802, None, "good.com"), (9803, "", "good.com"), (9804, kinds["symbols.com"], "tiny.com"), (9805, kinds["symbols.com"], "good.com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit("clash")).withColumn("host_failed", F.lit(1)).withColumn("n", F.lit(2))
    failed = plain_hosts(rows)
    assert {h: failed[h] for h in kinds} == {"short.com": "base", "lines.com": "lines", "symbols.com": "symbols", "long.com": "lengths"} and not any("mixed" in h or "good" in h for h in failed)
    got = quality.judge_quality(docs).collect()
    assert {x.doc_id: (x.kept, x.host_failed) for x in got} == {i: (not plain_quality(t)[-1] and h not in failed, failed.get(h)) for i, t, h in rows} and len(got) == len(rows)
    duck = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841  the view of the SQL
    duck.register("documents", documents)
    same = duck.sql(quality.ORACLE).df()
    assert sorted(zip(same.doc_id, same.kept, strict=True)) == sorted((x.doc_id, x.kept) for x in got) and same.host_failed.notna().sum() == sum(x.host_failed is not None for x in got) > 150


def test_pipeline_against_a_plain_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(i, t) for i, t in rows if model.score(t) < toxicity.THRESHOLD]
    rows.sort()
    rows = [row for k, (row, low) in enumerate(zip(rows, plain_components(rows), strict=True)) if k == low]
    known = decontaminate.Words()
    items = [known.of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(i, pii.redact(t)) for i, t in rows if not any(_overlap(known.of(t), own) for own in items)]
    from tokenizers import Tokenizer

    from mnemex.llm.bpe import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    wanted = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()} == wanted


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("stages"))
    r = random.Random(4)
    words = "lorem ipsum dolor sit amet elit sed eiusmod tempor".split()
    bad = [(500 + i, " ".join(r.choice(words) for _ in range(20)) + (" idiot" if i % 4 == 0 else "")) for i in range(80)]
    item = " ".join(f"passage{k}" for k in range(20))
    rows = [*TEXTS, *bad, (900, f"before {item} after"), (901, f"before {item} after"), (902, "mail me at a@b.co today please do"), (903, "mail me at a@b.co today please do")]
    documents(spark, rows).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, 1, int("idiot" in t)) for i, t in bad], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, item), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return home


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_what_goes_wrong(spark, tables, name, stage):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    odd = docs.withColumnRenamed("fp", "_id").withColumnRenamed("low", "term").withColumnRenamed("key", "rid").withColumnRenamed("digest", "score")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for given in (docs, odd):
        got = stage(spark, given, tables)
        assert name == "bpe" or got.columns == given.columns
        assert stage(spark, given.where("false"), tables).count() == 0
    kept = sorted(str(r.doc_id) for r in got.collect())
    ids = sorted(str(i) for i, _ in rows)
    if name in ("pii", "bpe"):
        assert kept == ids
    elif name == "toxicity":
        gone = {i for i, t in rows if t and "idiot" in t}
        assert kept == sorted(str(i) for i, _ in rows if i not in gone)
    elif name == "decontamination":
        assert kept == sorted(str(i) for i, _ in rows if i not in (900, 901))
    else:
        heads = {(d, fp) for d, fp, low in components([(i, t) for i, t in rows if i is not None]) if d == str(low)}
        assert kept == sorted([d for d, _ in heads] + ["None"])
    if name == "pii":
        texts = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
        assert texts[902] == ("mail me at <EMAIL> today please do", 34) and texts[2] == (None, None) and texts[3] == ("", 0)
    if name == "bpe":
        by_id = {r.doc_id: r for r in got.collect()}
        assert by_id[2].n_tokens == by_id[3].n_tokens == 0 and list(by_id[2].ids) == []


def _overlap(words, own):
    same = own[:, None] == words[None, :]
    if same.any(axis=1).sum() < 10:
        return False
    diagonals = (np.diagonal(same, d) for d in range(12 - len(own), len(words) - 11))
    return any(len(d) >= 12 and np.convolve(d, np.ones(12))[11 : len(d)].max() >= 10 for d in diagonals)
