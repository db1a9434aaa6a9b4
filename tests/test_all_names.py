"""Alignment of names by all three steps: against brute force over all pairs."""

import difflib
import random
import re

from mnemex.operators import ontology as O


def plain(left, right, near_left, near_right):
    norm = lambda n: re.sub("[^a-z0-9]+", " ", n.lower()).strip()
    out = {}
    for a in left:
        found = []
        for b in right:
            x, y = norm(a), norm(b)
            p, q = {norm(n) for k, n in near_left if k == a}, {norm(n) for k, n in near_right if k == b}
            ratio, shared = difflib.SequenceMatcher(None, x, y).ratio(), len(p & q) / len(p | q) if p | q else 0
            if x == y:
                found.append((0, -1.0, b))
            elif ratio >= 0.75:
                found.append((1, -ratio, b))
            elif shared >= 0.6:
                found.append((2, -shared, b))
        if found:
            _, minus, b = min(found)
            out[a] = (b, round(-minus, 6))
    return out


def check(spark, left, right, near_left, near_right):
    frame = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    got = O.align(frame([(x,) for x in left], ["name"]), frame([(x,) for x in right], ["other"]), frame(near_left, ["name", "neighbour"]), frame(near_right, ["other", "neighbour"]))
    got = {r["name"]: (r["match"], r["score"]) for r in got.collect()}
    assert got == plain(left, right, near_left, near_right)
    return got


def test_each_step_decides(spark):
    left, right = ["Big-Org", "xperson", "Town", "alone", "abc"], ["big org", "person", "city", "bac", "other"]
    near_left, near_right = [("Town", "In"), ("Town", "has"), ("Town", "near"), ("alone", "q")], [("city", "in"), ("city", "HAS"), ("city", "near"), ("city", "of"), ("other", "z")]
    got = check(spark, left, right, near_left, near_right)
    assert got["Big-Org"] == ("big org", 1.0) and got["xperson"][0] == "person" and got["Town"] == ("city", 0.75) and "alone" not in got


def test_no_lexical_pair_is_lost(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 9)))
    assert len(check(spark, sorted({word() for _ in range(120)}), sorted({word() for _ in range(120)}), [("a", "n")], [("b", "n")])) > 50
