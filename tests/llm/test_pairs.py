"""Pairs against brute force, hot baskets and blocks included."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import pytest

from tribuna.llm import pairs


def brute(rows, least):
    held: dict = {}
    for item, basket in set(rows):
        if item is not None and basket is not None:
            held.setdefault(basket, set()).add(item)
    n, ab = Counter(i for s in held.values() for i in s), Counter()
    for s in held.values():
        ab.update(itertools.combinations(sorted(s), 2))
    return {(a, b): (k, n[a], n[b], len(held)) for (a, b), k in ab.items() if k >= least}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [3, 256])
def test_like_brute_force(spark, seed, block):
    r = random.Random(seed)
    rows = [(f"i{min(r.randint(0, 30), r.randint(0, 30))}", r.choice(["hot1", "hot2", *(f"b{k}" for k in range(40))])) for _ in range(900)]
    rows += [(f"i{k}", h) for k in range(31) for h in ("hot1", "hot2", "hot3")] + [(None, "b1"), ("i1", None)] + rows[:50]
    df = spark.createDataFrame([(a, b, "z") for a, b in rows], "nome string, cesta string, item string")
    got = {(x.a, x.b): (x.n_ab, x.n_a, x.n_b, x.baskets) for x in pairs.pairs(df, "nome", "cesta", least=6, block=block).collect()}
    assert got == brute(rows, 6)


def test_measures_and_empty(spark):
    df = spark.createDataFrame([(i, b) for b in "pq" for i in "xy"] + [("x", "r")], "i string, b string")
    x = pairs.pairs(df, "i", "b", least=2).first()
    assert (x.n_ab, x.n_a, x.n_b, x.baskets) == (2, 3, 2, 3) and math.isclose(x.lift, 1.0) and math.isclose(x.pmi, 0.0, abs_tol=1e-12)
    assert pairs.pairs(df.limit(0), "i", "b").collect() == []
