from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from changegraph.operators import consensus, ranges


def test_innermost_like_brute_force(spark):
    rnd = random.Random(3)
    spans = [(rnd.choice("fg"), s := rnd.randrange(300), s + rnd.choice([0, 3, 40, 9000]), i) for i in range(80)] + [("f", None, 5, 80), ("f", 9, 3, 81), (None, 1, 2, 82)]
    places = [(i, rnd.choice("fgh"), rnd.choice([*range(320), 5000])) for i in range(200)]
    got = ranges.innermost(spark.createDataFrame(places, "p long, file string, line int"), spark.createDataFrame(spans, "file string, start int, end int, n long"), ["file"], ["p"], "line", "n").collect()

    def best(f, x):
        inside = [s for s in spans if s[0] == f and s[1] is not None and s[1] <= x <= s[2]]
        return max(inside, key=lambda s: (s[1], -s[3]))[3] if inside else None

    assert {r["p"]: r["n"] for r in got} == {p: best(f, x) for p, f, x in places}


def test_nearest_before_else_after(spark):
    things = spark.createDataFrame([("f", 10, 1), ("f", 20, 2), ("f", 20, 3), ("f", None, 4)], "file string, start int, n long")
    places = spark.createDataFrame([(1, "f", 5), (2, "f", 15), (3, "f", 20), (4, "f", 99), (5, "g", 1)], "p long, file string, line int")
    got = ranges.nearest(places, things, ["file"], ["p"], "line", "start", "n")
    assert {r["p"]: r["n"] for r in got.collect()} == {1: 1, 2: 1, 3: 2, 4: 2, 5: None}


def test_overlapping(spark):
    left = spark.createDataFrame([(1, "f", 1, 5), (2, "f", 6, 7), (3, "f", 0, 99999), (4, "g", 1, 9)], "n long, file string, start int, end int")
    right = spark.createDataFrame([("f", 5, 5), ("f", 70000, 70001)], "file string, s int, e int")
    assert sorted(r["n"] for r in ranges.overlapping(left, right, ["file"], "start", "end", "s", "e").collect()) == [1, 3]


def test_nearest_in_files_of_many_bins(spark):
    rnd = random.Random(12)
    things = [("hot" if rnd.random() < 0.6 else "cold", rnd.choice("ab"), rnd.randrange(3000) if rnd.random() < 0.95 else None, i) for i in range(300)]
    places = [(rnd.choice(["hot", "cold", "none"]), rnd.choice("ab"), rnd.randrange(-50, 3100), i) for i in range(200)]
    p, t = spark.createDataFrame(places, "f string, l string, at int, k int"), spark.createDataFrame(things, "f string, l string, s int, n int")
    got = {r["k"]: r["n"] for r in ranges.nearest(p, t, ["f", "l"], ["k"], "at", "s", "n").collect()}
    for f, l, at, k in places:
        mine = [(s, n) for tf, tl, s, n in things if (tf, tl) == (f, l) and s is not None]
        before = [x for x in mine if x[0] <= at]
        want = max(before, key=lambda x: (x[0], -x[1]))[1] if before else min(mine)[1] if mine else None
        assert got[k] == want


def test_intervals_of_all_lengths(spark):
    rnd = random.Random(13)
    intervals = [(rnd.choice("ab"), s := rnd.randrange(10**6), s + rnd.choice([0, 10, 5000, 10**6, 2 * 10**9 - s]), i) for i in range(80)] + [("a", 5, 4, 90), ("a", None, 4, 91)]
    places = [(rnd.choice("abc"), rnd.randrange(2 * 10**6), i) for i in range(80)]
    p, t = spark.createDataFrame(places, "f string, at int, k int"), spark.createDataFrame(intervals, "f string, start int, end int, n int")
    got = sorted((r["k"], r["n"]) for r in ranges.containing(p, t, ["f"], "at").collect())
    assert got == sorted((k, n) for f, at, k in places for g, s, e, n in intervals if f == g and s is not None and s <= at <= e)
    assert ranges.containing(p, t.limit(0), ["f"], "at").count() == 0


@pytest.mark.parametrize("at_least", [0.0, 0.3, 0.5, 1.0])
def test_overlaps_like_brute_force(spark, at_least):
    rnd = random.Random(14)
    sets = {k: {rnd.choice(["hot", *"abcdefg"]) for _ in range(rnd.randrange(1, 6))} for k in range(30)}
    df = spark.createDataFrame([(k, e) for k, s in sets.items() for e in s], "k int, e string")
    got = consensus.overlaps(df.withColumnRenamed("k", "x"), df.withColumnRenamed("k", "y"), "x", "y", "e", F.col("x") < F.col("y"), at_least)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert {(r["x"], r["y"]): round(r["jaccard"], 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items() if v >= at_least}


def test_running_values_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(ranges, "STRETCH", 7)
    rnd = random.Random(15)
    rows = [(rnd.choice("ab"), n, rnd.choice([None, None, n * 10])) for n in rnd.sample(range(300), 90)]
    df = spark.createDataFrame(rows, "g string, n long, v long")
    count = {r["n"]: r["c"] for r in ranges.running_count(df, ["g"], "n", F.col("v").isNull(), "c").collect()}
    last = {r["n"]: r["x"] for r in ranges.last_before(df, ["g"], "n", "v", "x").collect()}
    for g, n, _ in rows:
        upto = sorted((m, v) for h, m, v in rows if h == g and m <= n)
        assert count[n] == sum(v is None for _, v in upto)
        assert last[n] == next((v for _, v in reversed(upto) if v is not None), None)
