from __future__ import annotations

import random
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from changegraph.llm import packing


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=5), st.integers(0, 60))
def test_fullest_is_the_best_sum(available, room):
    got = packing.fullest(available, room)
    assert all(0 < n <= available[k] for k, n in got.items())
    sums = {sum(k * n for k, n in zip(available, ns)) for ns in product(*(range(n + 1) for n in available.values()))}
    assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)


def packed(spark, sizes, capacity):
    df = spark.createDataFrame([(i, n, "x", 1) for i, n in enumerate(sizes)], "id long, n long, k string, container int")
    rows = packing.pack(spark, df, "id", "n", capacity).collect()
    for i, n in enumerate(sizes):
        mine = sorted((r["piece_no"], r["start"], r["length"]) for r in rows if r["id"] == i)
        assert sum(x[2] for x in mine) == max(n or 0, 0)
        assert [x[0] for x in mine] == list(range(len(mine)))
        assert all(x[1] == p * capacity for p, x in enumerate(mine))
        assert len(mine) == max(1, -(-max(n or 0, 0) // capacity))
    bins: dict = {}
    for r in rows:
        if r["length"]:
            bins.setdefault(r["container"], []).append((r["position"], r["length"]))
        else:
            assert r["container"] is None and r["position"] is None
    for items in bins.values():
        assert sorted(p for p, _ in items) == list(range(len(items)))
        assert sum(x for _, x in items) <= capacity
    assert set(bins) == set(range(len(bins)))
    return len(bins)


@pytest.mark.parametrize("capacity", [10, 100, 997])
def test_round_trip_and_little_waste(spark, capacity):
    rnd = random.Random(capacity)
    sizes = [rnd.choice([1, 7, capacity, rnd.randrange(1, capacity * 3)]) for _ in range(400)]
    pieces = sorted((x for n in sizes for x in [capacity] * (n // capacity) + [n % capacity] * (n % capacity > 0)), reverse=True)
    rooms: list[int] = []
    for x in pieces:  # first fit decreasing
        at = next((i for i, room in enumerate(rooms) if room >= x), None)
        if at is None:
            rooms.append(capacity - x)
        else:
            rooms[at] -= x
    assert packed(spark, sizes, capacity) <= len(rooms)


def test_hot_length_null_empty_and_repeats(spark):
    assert packed(spark, [3] * 300 + [None, 0, -4, 10, 11], 10) == 102
    assert packed(spark, [3] * 300, 10) == 100
    assert packed(spark, [], 10) == 0
    assert packed(spark, [0, None], 10) == 0


def test_capacity_must_make_sense(spark):
    with pytest.raises(ValueError):
        packed(spark, [1], 0)
