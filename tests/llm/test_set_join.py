from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changegraph.llm import set_join
from changegraph.session import Stash


def brute(sets, num, den):
    out = set()
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and Fraction(len(x & y), len(x | y)) >= Fraction(num, den):
                out.add((a, b))
    return out


def joined(spark, rows, num=3, den=5):
    df = spark.createDataFrame(rows, "id long, v array<string>, class_no string, record int")
    stash = Stash(spark)
    members, classes = set_join.set_classes(spark, stash, df, "id", "v")
    pairs = stash.put(set_join.similar_classes(spark, stash, classes, num, den))
    got = [(r["record_a"], r["record_b"]) for r in set_join.similar_records(members, pairs).collect()]
    assert len(got) == len(set(got))
    links = {r["record"]: r["links"] for r in set_join.class_links(members, pairs).collect()}
    ends = Counter(x for p in got for x in p)
    assert all(links[x] == ends.get(x, 0) for x in links)
    return set(got)


def some_sets(seed, n=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    out = {}
    for i in range(n):
        base = set(rnd.sample(words, rnd.randrange(1, 9)))
        out[i] = base if rnd.random() < 0.5 or not i else (out[rnd.randrange(i)] ^ set(rnd.sample(words, 1)))
    return out


@pytest.mark.parametrize(("seed", "block", "t"), [(1, 4000, (3, 5)), (2, 5, (3, 5)), (3, 3, (4, 5)), (4, 4000, (1, 3)), (5, 7, (1, 1))])
def test_like_brute_force(spark, monkeypatch, seed, block, t):
    monkeypatch.setattr(set_join, "BLOCK", block)  # small blocks cut every value into pairs of blocks
    sets = some_sets(seed)
    rows = [(i, [*s, *s, None], "x", 1) for i, s in sets.items()]
    assert joined(spark, [*rows, *rows[:20]], *t) == brute(sets, *t)


def test_values_that_share_a_hash(spark, monkeypatch):
    right = set_join._hash
    seeds = []

    def weak(value, seed):
        seeds.append(seed)
        return right(value, seed) if seed > 1 else F.pmod(right(value, seed), F.lit(5))

    monkeypatch.setattr(set_join, "_hash", weak)
    sets = some_sets(6)
    assert joined(spark, [(i, list(s), "x", 1) for i, s in sets.items()]) == brute(sets, 3, 5)
    assert set(seeds) == {0, 1, 2}


def test_odd_records(spark):
    long = [f"t{i}" for i in range(5000)]
    rows = [(1, None, "", 0), (2, [], "", 0), (3, [None], "", 0), (4, [""], "", 0), (5, [""], "", 0), (6, long, "", 0), (7, long[:-1], "", 0), (None, ["a"], "", 0)]
    assert joined(spark, rows) == {(4, 5), (6, 7)}
    assert joined(spark, []) == set()


@given(st.lists(st.lists(st.integers(0, 15), max_size=12, unique=True).map(sorted), min_size=1, max_size=8).filter(lambda x: any(x)), st.integers(1, 6))
def test_occurring_counts(lists, least):
    lists = [x for x in lists if x]
    want = Counter(m for x in lists for m in x)
    assert sorted(set_join.occurring(lists, least)) == sorted((m, n) for m, n in want.items() if n >= least)
