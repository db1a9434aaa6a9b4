"""Periodic runs against a plain search, for every exponent; what the query returns against the contract."""

import hashlib
import random
import zlib

import pytest

from mnemex.llm import periodic_runs
from tests.llm.common import TEXTS, documents, none


def plain(words, exponent=4, least=6):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if j > i and len(own) >= max(least, exponent * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                out.append((i, len(own), q))
            i = max(j, i) + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def texts(seed, times):
    r = random.Random(seed)
    for _ in range(times):
        own = []
        for _ in range(r.randint(1, 12)):
            t = [r.choice("abcd"[: r.randint(1, 4)]).encode() for _ in range(r.randint(0, 50))]
            t += [r.choice("abcd").encode() for _ in range(r.randint(1, 5))] * r.randint(0, 9)
            own.append(t * r.choice((1, 1, 2, 5)))
        yield own


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 1)])
def test_runs_against_a_plain_search(exponent, least):
    for own in texts(exponent, 60):
        assert periodic_runs.runs_of(own, exponent, least) == [plain(t, exponent, least) for t in own]


def test_runs_inside_runs_and_long_ones():
    inner = [b"a"] * 7 + [b"b"]
    text = (inner * 2 + [b"c"]) * 5  # runs that stand in copied blocks of copied blocks
    assert periodic_runs.runs_of([text])[0] == plain(text)
    assert periodic_runs.runs_of([[b"x"] * 300_000, [], [b"x"] * 5]) == [[(0, 300_000, 1)], [], []]
    fib = [b"a"], [b"b", b"a"]
    for _ in range(10):
        fib = fib[1], fib[1] + fib[0]
    assert periodic_runs.runs_of([fib[1]], 2, 2)[0] == plain(fib[1], 2, 2)
    with pytest.raises(ValueError):
        periodic_runs.runs_of([[b"a"]], 1)


def test_previous_factors_and_blocks():
    import numpy as np

    for own in texts(9, 20):
        stops = np.cumsum([len(t) for t in own])
        flat = [(k, w) for k, t in enumerate(own) for w in t]
        codes = {x: i for i, x in enumerate(sorted(set(flat)))}
        tables = periodic_runs.rank_tables(np.array([codes[x] for x in flat]), np.repeat(stops, [len(t) for t in own]))
        length, source = periodic_runs.previous_factors(tables)
        for k, t in enumerate(own):
            at = int(stops[k]) - len(t)
            for i in range(len(t)):
                most = max((next((d for d in range(len(t) - i) if t[j + d] != t[i + d]), len(t) - i) for j in range(i)), default=0)
                assert length[at + i] == most
                if most:
                    j = int(source[at + i]) - at
                    assert 0 <= j < i and t[j : j + most] == t[i : i + most]


def wanted(key, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return (key, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_a_plain_one(spark, sf):
    r = random.Random(4)
    rows = [(i, t if t is None or len(t) < 5000 else t[:5000]) for i, t in TEXTS]
    rows += [(k, " \x0b".join(r.choice(("a", "b ", "ü")) for _ in range(r.randint(0, 60)))) for k in range(100, 260)]
    got = periodic_runs.op11(documents(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(wanted(i, t)) for i, t in rows)
    assert sum(x.n_runs > 0 for x in got) > 20
    assert periodic_runs.op11(none(spark)).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 6000 OR text IS NULL")
    assert sorted(map(repr, map(tuple, periodic_runs.op11(docs).collect()))) == sorted(repr(wanted(*x)) for x in docs.collect())


def test_general_interface(spark):
    got = periodic_runs.periodic_runs(documents(spark, [(1, "z a b a b a b a b y")])).first()
    assert [tuple(x) for x in got.runs] == [(1, 8, 2)] and got.collapsed == "z a b y"
