"""Near copies against all pairs of shingle sets: at the given tables, in crowds, and around the threshold."""

import random

import pytest

from mnemex.llm import near_copies, simhash
from mnemex.shared import Workspace
from tests.llm.common import TEXTS, documents, none


def plain_sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    return out


def plain_links(rows):
    """Pairs of rows with similarity of 0.8 or more; equal sets too."""
    sets = plain_sets(rows)
    by_item = {}
    for k, s in enumerate(sets):
        for x in s:
            by_item.setdefault(x, []).append(k)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if not sets[a] and not sets[b]] if sum(not s for s in sets) < 50 else []
    shared = {}
    for own in by_item.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                shared[a, b] = shared.get((a, b), 0) + 1
    return links + [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]


def plain_components(rows):
    low = list(range(len(rows)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in plain_links(rows):
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return [root(x) for x in range(len(rows))]


def changed(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"other{r.randrange(10**6)}"
    return words


def components(spark, rows):
    got = near_copies.near_copies(documents(spark, rows).repartition(5), "doc_id", "text").collect()
    return {r.key: r.component for r in got}


def test_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.key: r.component for r in near_copies.near_copies(docs, "doc_id", "text").collect()}
    want = plain_components(rows)
    assert got == {i: rows[c][0] for (i, _), c in zip(rows, want, strict=True)}


def test_recall_around_the_threshold(spark):
    r = random.Random(5)
    rows = []
    for k in range(0, 600, 2):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 120))]
        rows += [(k, " ".join(words)), (k + 1, " ".join(changed(r, words, r.choice((1, 1, 2)))))]
    near = [(a, b) for a, b in plain_links(rows)]
    got = components(spark, rows)
    found = sum(got[rows[a][0]] == got[rows[b][0]] for a, b in near)
    assert len(near) > 150 and found / len(near) >= 0.98
    sets = plain_sets(rows)
    for i in range(0, 600, 2):  # and what is less similar stays apart
        both = len(sets[i] & sets[i + 1])
        if both < 0.8 * (len(sets[i]) + len(sets[i + 1]) - both):
            assert got[i] != got[i + 1]


@pytest.mark.parametrize(("crowd", "block"), [(64, 4096), (4, 4096), (4, 24)])
def test_crowds_of_copies(spark, monkeypatch, crowd, block):
    """Copies of one text, each changed in another place: near to the text, not always to each other."""
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    r = random.Random(6)
    words = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = [(500, " ".join(words))] + [(k, " ".join(changed(r, words, r.choice((1, 2))))) for k in range(1, 150)] + [(k, " ".join(f"x{r.randrange(10**5)}" for _ in range(40))) for k in range(200, 240)]
    got = components(spark, rows)
    want = plain_components(sorted(rows))
    own = sorted(rows)
    right = sum(got[i] == own[c][0] for (i, _), c in zip(own, want, strict=True))
    assert right >= 0.97 * len(rows) and all(got[k] == k for k in range(200, 240))


def crowd_of_groups(r):
    """Texts that share enough to meet all in the same groups of hashes, but are near only in twos and threes; and some that share less."""
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    rows = []
    for k in range(150):
        own = base + [f"t{k}x{r.randrange(10**5)}" for _ in range(50)]
        rows += [" ".join(own)] + [" ".join(own[:-5] + changed(r, own[-5:], n)) for n in r.sample((1, 3, 5), r.choice((1, 2)))]
    rows += [" ".join(base[: r.randint(60, 149)] + [f"u{r.randrange(10**6)}" for _ in range(r.randint(0, 40))]) for _ in range(60)]
    ids = r.sample(range(10**6), len(rows))
    return sorted(zip(ids, rows, strict=True))


def test_no_link_of_a_crowd_is_lost(spark):
    rows = crowd_of_groups(random.Random(8))
    got = components(spark, rows)
    assert got == {i: rows[c][0] for (i, _), c in zip(rows, plain_components(rows), strict=True)}


@pytest.mark.parametrize(("crowd", "block"), [(2, 4096), (2, 24)])
def test_crowds_are_exact(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    r = random.Random(9)
    words = [f"w{r.randrange(5000)}" for _ in range(90)]
    rows = sorted((k, " ".join(changed(r, words, r.choice((1, 2, 3))))) for k in r.sample(range(1000), 120))
    got = components(spark, rows)
    assert got == {i: rows[c][0] for (i, _), c in zip(rows, plain_components(rows), strict=True)}


def test_links_without_any_proposal(spark, monkeypatch):
    """Sets of all sizes around the threshold, none proposed: the join by leading shingles alone finds every link, with common shingles last or not."""
    monkeypatch.setattr(near_copies, "proposals", lambda heads, ws: heads.select(heads["head"].alias("a"), heads["head"].alias("b")).where("false"))
    r = random.Random(10)
    rows = []
    for k in range(0, 900, 3):
        words = [f"w{r.randrange(400)}" for _ in range(r.randint(1, 60))]
        rows += [(k, " ".join(words)), (k + 1, " ".join(words + words[: r.randint(0, 9)])), (k + 2, " ".join(changed(r, words, 1)))]
    want = {i: rows[c][0] for (i, _), c in zip(rows, plain_components(rows), strict=True)}
    assert sum(i != c for i, c in want.items()) > 150
    assert components(spark, rows) == want
    monkeypatch.setattr(near_copies, "SAMPLE", 0)
    assert components(spark, rows) == want


def test_a_shared_passage_brings_no_pairs(spark, monkeypatch):
    """Two thirds of each text are one passage, which no sample has shown: only the copies meet, not all texts with all."""
    monkeypatch.setattr(near_copies, "SAMPLE", 0)
    r = random.Random(11)
    passage = [f"w{k}" for k in range(130)]
    own = [[f"t{k}x{i}" for i in range(60)] for k in range(80)]
    rows = [(k, " ".join(passage + x)) for k, x in enumerate(own)] + [(100 + k, " ".join(passage + changed(r, own[k], 2))) for k in range(0, 80, 8)]
    monkeypatch.setattr(near_copies, "proposals", lambda heads, ws: heads.select(heads["head"].alias("a"), heads["head"].alias("b")).where("false"))
    ws = Workspace(spark, "passage")
    got = {x.key: x.component for x in near_copies.near_copies(documents(spark, rows), "doc_id", "text", ws).collect()}
    assert got == {i: rows[c][0] for (i, _), c in zip(rows, plain_components(rows), strict=True)} and sum(i != c for i, c in got.items()) == 10
    assert spark.read.parquet(ws.path("found")).count() <= len(rows)


def test_odd_texts(spark):
    rows = [(i, t) for i, t in TEXTS if i is not None]
    got = near_copies.near_copies(documents(spark, rows), "doc_id", "text").collect()
    assert len(got) == len(rows)
    by_id = {r.key: r.component for r in got}
    assert by_id[2] == by_id[3] == by_id[4] == 2 and by_id[5] == by_id[6] == by_id[10] == 5 and by_id[8] == 8 and by_id[12] == 12
    assert near_copies.near_copies(none(spark), "doc_id", "text").count() == 0


def test_one_document_of_a_group_stays(spark):
    r = random.Random(7)
    words = [f"w{k}" for k in range(100)]
    rows = [(9, " ".join(words)), (3, " ".join(changed(r, words, 1))), (4, "something else that is long enough to count here"), (3, " ".join(words[:50])), (None, " ".join(words)), (8, None), (7, " ")]
    got = simhash.near_dedup(documents(spark, rows + [(4, rows[2][1])])).collect()
    assert sorted((str(x.doc_id), x.text) for x in got) == sorted([("3", rows[1][1]), ("3", rows[3][1]), ("4", rows[2][1]), ("None", rows[4][1]), ("7", " ")])
    assert [x.n_chars for x in got if x.doc_id == 4] == [len(rows[2][1])]
