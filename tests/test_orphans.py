from __future__ import annotations

import itertools
import random
from datetime import datetime

import pytest

from changegraph.operators.orphans import orphan_report, orphans

DAY = [datetime(2025, 1, i + 1) for i in range(28)]
REFS = "a string, b string, at timestamp_ntz, owner long, kind string, _begin string"
TARGETS = "a string, b string, live_from timestamp_ntz, live_to timestamp_ntz, owner long"


def brute(refs, targets, match):
    out = []
    for a, b, at, owner, *_ in refs:
        key = (a, b)
        used = [i for i in (0, 1) if key[i] is not None]
        if not used or (match == "simple" and len(used) < 2):
            continue
        if match == "full" and len(used) < 2:
            out.append((owner, "missing"))
            continue
        same = [t for t in targets if all(t[i] == key[i] for i in used)]
        if any(t[2] and at and t[2] <= at and (t[3] is None or t[3] > at) for t in same):
            continue
        out.append((owner, "missing" if not same else "deleted" if any(t[2] and at and t[2] <= at for t in same) else "late"))
    return sorted(out)


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_like_brute_force(spark, match):
    rnd = random.Random(7)
    some = lambda: rnd.choice(["x", "y", "z", "hot", "hot", None, ""])
    refs = [(some(), some(), rnd.choice([*DAY, None]), i, "old", "clash") for i in range(150)]
    targets = [(some(), some(), rnd.choice([*DAY, None]), rnd.choice([*DAY, None]), 1) for _ in range(40)]
    got = orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS), ["a", "b"], match=match)
    assert sorted((r["owner"], r["kind"]) for r in got.collect()) == brute(refs, targets, match)
    assert got.columns == ["a", "b", "at", "owner", "_begin", "kind"]


def test_empty_tables(spark):
    none, no_target = spark.createDataFrame([], REFS), spark.createDataFrame([], TARGETS)
    one = spark.createDataFrame([("x", "y", DAY[0], 1, "", "")] * 2, REFS)
    assert orphans(none, no_target, ["a", "b"]).count() == 0
    assert [r["kind"] for r in orphans(one, no_target, ["a", "b"]).collect()] == ["missing"] * 2  # repeats are kept
    report = orphan_report(orphans(one, no_target, ["a", "b"]), ["owner"]).collect()
    assert [(r["owner"], r["kind"], r["orphans"], r["period_start"].month) for r in report] == [(1, "missing", 2, 1)]


def test_ends_of_life(spark):
    targets = [("x", "y", DAY[2], DAY[4], 0)]
    refs = [("x", "y", DAY[i], i, "", "") for i in range(7)]
    got = orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS), ["a", "b"])
    kinds = {r["owner"]: r["kind"] for r in got.collect()}
    assert kinds == {0: "late", 1: "late", 4: "deleted", 5: "deleted", 6: "deleted"}


def test_unknown_semantics(spark):
    with pytest.raises(ValueError):
        orphans(spark.createDataFrame([], REFS), spark.createDataFrame([], TARGETS), ["a"], match="none")
    assert list(itertools.product((True, False), repeat=1))
