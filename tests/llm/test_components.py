from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from changegraph.llm import components as C
from changegraph.llm.components import components


def union_find(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in up}


def check(spark, pairs, finish=0):
    """finish: how many links one task may solve; 0 leaves all to the rounds."""
    df = spark.createDataFrame([(a, b, "c", 1) for a, b in pairs], "l long, r long, vertex string, component int")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(C, "FINISH", finish)
        got = components(spark, df, "l", "r")
    assert {r["vertex"]: r["component"] for r in got.collect()} == union_find(pairs)


def test_shapes(spark):
    path = [(i, i + 1) for i in range(0, 40)]
    ring = [(100 + i, 100 + (i + 1) % 13) for i in range(13)]
    star = [(299, 200 + i) for i in range(30)]
    clique = [(a, b) for a in range(300, 307) for b in range(300, 307)]
    grid = [(400 + 6 * r + c, 400 + 6 * r + c + 1) for r in range(5) for c in range(5)] + [(400 + 6 * r + c, 400 + 6 * r + c + 6) for r in range(4) for c in range(6)]
    joined = [(40, 500), (500, 501), (501, 502), (502, 500), (500, 503), (503, 300)]
    odd = [(None, 1), (1, None), (None, None), (900, 900), (901, 901), (902, 901), (7, 6), (7, 6)]
    pairs = path + ring + star + clique + grid + joined + odd
    random.Random(1).shuffle(pairs)
    check(spark, pairs)


def test_two_parallel_chains_and_a_loop(spark):
    check(spark, [(1, 2), (2, 3), (3, 9), (1, 4), (4, 9), (9, 10), (10, 11), (11, 9), (1, 20), (1, 21), (9, 22), (9, 23)])


def test_nothing(spark):
    check(spark, [])
    check(spark, [(None, 5)])
    check(spark, [(5, 5)])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=45))
def test_random(spark, pairs):
    check(spark, pairs)


@pytest.mark.parametrize("seed", [3])
def test_random_sparse(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(380)]
    for finish in (0, 100, 4096):
        check(spark, pairs, finish)


def test_a_loop_that_does_not_end_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="rounds"):
        check(spark, [(i, i + 1) for i in range(100)] + [(0, 200), (0, 201), (100, 202), (100, 203), (200, 201), (202, 203)])
