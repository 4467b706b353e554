from __future__ import annotations

import random

import pytest

from changegraph.llm import consensus

SCHEMA = "item string, who string, label string, ctx string, votes string, code int"


def simulated(seed, items=300):
    rnd = random.Random(seed)
    skill = {"good1": 0.95, "good2": 0.9, "fair1": 0.75, "fair2": 0.7, "fair3": 0.7, "bad1": 0.15, "bad2": 0.15, "bad3": 0.2}
    truth = {f"i{i}": rnd.choice("abcde") for i in range(items)}
    rows = []
    for i, t in truth.items():
        for w in rnd.sample(sorted(skill), 5):
            rows.append((i, w, t if rnd.random() < skill[w] else rnd.choice([x for x in "abcde" if x != t]), "c", "clash", 0))
    return truth, skill, rows


def test_better_than_plurality(spark):
    truth, skill, rows = simulated(11)
    items, who, passes, step = consensus.consensus(spark, spark.createDataFrame(rows + rows[:50], SCHEMA), ["item"], "who", "label", ["ctx"])
    assert 1 < passes < consensus.PASSES and step < consensus.SETTLED
    got = {r["item"]: r for r in items.collect()}
    assert set(got) == set(truth)
    right = sum(got[i]["label"] == t for i, t in truth.items()) / len(truth)
    plural = 0
    for i, t in truth.items():
        labels = [r[2] for r in rows if r[0] == i]
        plural += max(sorted(set(labels)), key=labels.count) == t
    assert right > plural / len(truth) + 0.03 and right > 0.88
    ability = {r["annotator"]: r["ability"] for r in who.collect()}
    assert min(ability[w] for w in ("good1", "good2")) > max(ability[w] for w in ("bad1", "bad2", "bad3"))
    assert all(r["votes"] == 5 and 0 < r["confidence"] <= 1 and r["agreement"] <= 1 for r in got.values())


def test_many_annotators_take_the_other_way(spark, monkeypatch):
    _, _, rows = simulated(12, 80)
    df = spark.createDataFrame(rows, SCHEMA)
    one = {r["item"]: (r["label"], round(r["confidence"], 6)) for r in consensus.consensus(spark, df, ["item"], "who", "label", ["ctx"])[0].collect()}
    monkeypatch.setattr(consensus, "BROADCAST_ANNOTATORS", 0)
    two = {r["item"]: (r["label"], round(r["confidence"], 6)) for r in consensus.consensus(spark, df, ["item"], "who", "label", ["ctx"])[0].collect()}
    assert one == two


def test_odd_votes(spark):
    rows = [("a", "w", "x", "c", "", 0), ("a", "w", "y", "c", "", 0), (None, "w", "x", "c", "", 0), ("b", None, "x", "c", "", 0), ("c", "w", None, "c", "", 0), ("d", "v", "z", "c", "", 0), ("d", "w", "z", "c", "", 0)]
    items, who, *_ = consensus.consensus(spark, spark.createDataFrame(rows, SCHEMA), ["item"], "who", "label", ["ctx"])
    got = {r["item"]: (r["label"], r["votes"], r["labels"], r["agreement"]) for r in items.collect()}
    assert got["a"][0] in ("x", "y") and got["a"][1:] == (1, 2, None) and got["d"][:3] == ("z", 2, 1) and got["d"][3] == 1.0 and len(got) == 2
    assert {r["annotator"]: r["votes"] for r in who.collect()} == {"w": 2, "v": 1}
    items, who, *_ = consensus.consensus(spark, spark.createDataFrame([], SCHEMA), ["item"], "who", "label", ["ctx"])
    assert items.count() == 0 and who.count() == 0


def test_several_labels_of_an_annotator_share_a_vote(spark):
    rows = [("a", w, x, "c", "", 0) for w in ("u", "v", "w") for x in (("x", "y") if w == "u" else ("x",))] + [("b", w, x, "c", "", 0) for w in ("u", "v") for x in ("x", "y")]
    got = {r["item"]: r for r in consensus.consensus(spark, spark.createDataFrame(rows, SCHEMA), ["item"], "who", "label", ["ctx"]).items.collect()}
    assert got["a"]["label"] == "x" and got["a"]["votes"] == 3 and got["a"]["labels"] == 2
    shares = {"x": (2.5 + 1) / 5, "y": (0.5 + 1) / 5}
    chance = sum(p * p for p in shares.values())
    observed = {"a": (2.5**2 - 2.25 + 0.25 - 0.25) / 6, "b": 2 * (1 - 0.5) / 2}
    for i, o in observed.items():
        assert abs(got[i]["agreement"] - (o - chance) / (1 - chance)) < 1e-9


def test_learning_that_has_not_settled_is_told(spark):
    _, _, rows = simulated(13, 60)
    with pytest.warns(UserWarning, match="after 2 passes"):
        assert consensus.consensus(spark, spark.createDataFrame(rows, SCHEMA), ["item"], "who", "label", ["ctx"], passes=2, settled=1e-9).passes == 2


def test_hot_items_as_histograms(spark, monkeypatch):
    _, _, rows = simulated(14, 60)
    hot = [("hot", f"w{k}", "a" if k % 5 else "b", "c", "", 0) for k in range(400)] + [("hot", r[1], r[2], "c", "", 0) for r in rows[:8]]
    df = spark.createDataFrame(rows + hot, SCHEMA)
    ask = lambda: consensus.consensus(spark, df, ["item"], "who", "label", ["ctx"])
    one = ask()
    monkeypatch.setattr(consensus, "HOT_VOTES", 100)
    two = ask()
    a, b = ({r["item"]: r for r in x.items.collect()} for x in (one, two))
    assert set(a) == set(b) and all(a[i]["label"] == b[i]["label"] and abs(a[i]["confidence"] - b[i]["confidence"]) < 0.01 and a[i]["votes"] == b[i]["votes"] and abs(a[i]["agreement"] - b[i]["agreement"]) < 1e-9 for i in a)
    x, y = ({r["annotator"]: r["ability"] for r in z.annotators.collect()} for z in (one, two))
    assert set(x) == set(y) and all(abs(x[k] - y[k]) < 0.05 for k in x)


def test_a_histogram_of_a_million_votes_is_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(consensus, "HOT_VOTES", 1000)
    df = spark.range(1_000_000, numPartitions=8).selectExpr("'i' as item", "cast(id as string) as who", "if(id % 3 = 0, 'y', 'x') as label", "'c' as ctx")
    got = consensus.consensus(spark, df, ["item"], "who", "label", ["ctx"], passes=1, settled=100.0).items.collect()
    assert [(r["label"], r["votes"], r["labels"]) for r in got] == [("x", 1_000_000, 2)]
