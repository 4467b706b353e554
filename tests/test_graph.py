from __future__ import annotations

import random
from collections import deque

import pytest

from __spark_entry__ import queries
from changegraph.operators import graph
from changegraph.plans import graphs


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def bfs(pairs, origin, blocked=()):
    dist, q = {origin: 0}, deque([origin])
    while q:
        u = q.popleft()
        for a, b in pairs:
            if a == u and b not in dist and b not in blocked:
                dist[b] = dist[u] + 1
                q.append(b)
    return {n: x for n, x in dist.items() if n != origin}


def random_edges(seed, n=14, m=26):
    rnd = random.Random(seed)
    return sorted({(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(m)})


def origins(spark, names):
    return spark.createDataFrame([(x,) for x in names], "origin string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reach_is_breadth_first_search(spark, seed):
    pairs = random_edges(seed)
    names = sorted({x for p in pairs for x in p})[:6]
    want = {(o, n, d) for o in names for n, d in bfs([p for p in pairs if p[0] != p[1]], o).items()}
    e = edges_of(spark, [*pairs, *pairs, (None, "x"), ("n00", None)])
    assert {tuple(r) for r in graph.reach(spark, e, origins(spark, [*names, names[0], None])).select("origin", "node", "depth").collect()} == want
    with_paths = graph.reach(spark, e, origins(spark, names), paths=True).collect()
    assert {(r["origin"], r["node"], r["depth"]) for r in with_paths} == want
    for r in with_paths:
        assert r["path"][0] == r["origin"] and r["path"][-1] == r["node"] and len(r["path"]) == r["depth"] + 1
        assert all(p in pairs for p in zip(r["path"], r["path"][1:]))


def test_hubs_on_both_sides_are_not_multiplied_out(spark, monkeypatch):
    monkeypatch.setattr(graph, "FAR", 0)
    pairs = random_edges(5)
    got = graph.reach(spark, edges_of(spark, pairs), origins(spark, ["n00", "n01"]))
    assert {tuple(r) for r in got.select("origin", "node", "depth").collect()} == {(o, n, d) for o in ("n00", "n01") for n, d in bfs(pairs, o).items()}


def test_depth_bound_and_hidden(spark):
    pairs = [("a", f"b{i}") for i in range(5)] + [("b0", "c"), ("c", "d")]
    got = graph.bounded(spark, edges_of(spark, pairs), origins(spark, ["a"]), depth=2, most=4).collect()
    assert sorted((r["node"], r["depth"], r["hidden"]) for r in got) == [("b0", 1, 3), ("b1", 1, 3), ("b2", 1, 3)]


def test_no_edges(spark):
    none = edges_of(spark, [])
    assert graph.reach(spark, none, origins(spark, ["a"])).count() == 0
    assert graph.reach(spark, edges_of(spark, [("a", "b")]), origins(spark, [])).count() == 0
    assert graph.connected(spark, none, spark.createDataFrame([("a",)], "node string")).collect() == [("a", "a")]


def test_two_flows_meet(spark):
    pairs = [("h1", "m"), ("h2", "m"), ("m", "below"), ("h1", "own")]
    steps = spark.createDataFrame([("s1", "f1", "h1"), ("s2", "f2", "h2")], "step string, flow string, handler string")
    noise = spark.createDataFrame([], "node string")
    assert [tuple(r) for r in graph.merges(spark, edges_of(spark, pairs), steps, noise).collect()] == [("m", 2, 2)]


@pytest.mark.parametrize("seed", range(4))
def test_connected_is_union_find(spark, seed):
    pairs = random_edges(seed, n=30, m=22)
    nodes = {f"n{i:02}" for i in range(30)}
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = graph.connected(spark, edges_of(spark, pairs), spark.createDataFrame([(n,) for n in nodes], "node string"))
    assert {r["node"]: r["component"] for r in got.collect()} == label


def test_layers(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "d")]
    got = graph.layers(spark, edges_of(spark, pairs), spark.createDataFrame([("a",)], "node string"))
    assert {r["node"]: r["depth"] for r in got.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_moved_reach_and_its_cause(spark):
    base = [("h", "a"), ("a", "b")]
    head = [("h", "a"), ("a", "c"), ("c", "d")]
    entries = spark.createDataFrame([("E", "h"), ("F", "z")], "endpoint string, handler string")
    nodes = spark.createDataFrame([(x,) for x in "habcdz"], "node string")
    got = graph.reach_diff(spark, edges_of(spark, base), edges_of(spark, head), entries, entries, nodes).collect()
    assert sorted(map(tuple, got)) == [("E", "b", "lost"), ("E", "c", "gained"), ("E", "d", "gained")]
    changed = edges_of(spark, [("a", "c"), ("c", "d")])
    cause = graph.nearest_causes(spark, edges_of(spark, head), changed, spark.createDataFrame([("d",), ("c",)], "node string")).collect()
    assert sorted(map(tuple, cause)) == [("c", "a", "c"), ("d", "c", "d")]


def test_component_matrix_has_every_flow(spark, monkeypatch):
    rows = [(f"s{k}", f"flow-{k % 7}", c) for k in range(20) for c in ("a/b", "c/d")[: 1 + k % 2]] + [("s0", "read-a-meter", "a/b")]
    monkeypatch.setattr(graphs, "components_of", lambda *_: spark.createDataFrame([*rows, rows[0]], "step string, flow string, component string"))
    want = {(c, f): len({x for x, g, y in rows if (g, y) == (f, c)}) for _, f, c in rows}
    got = queries()["component_matrix"](spark, "")
    assert {(r["component"], r["flow"]): r["steps"] for r in got.collect()} == want and got.count() == len(want)


def test_layers_behind_cycles(spark):
    edges = [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("r", "f"), ("b", "x"), ("x", "f"), ("other", "a")]
    e = spark.createDataFrame(edges, "src string, dst string")
    got = {r["node"]: r["depth"] for r in graph.layers(spark, e, spark.createDataFrame([("r",)], "node string")).collect()}
    assert got == {"r": 0, "a": 1, "b": 1, "c": 1, "d": 2, "e": 2, "x": 2, "f": 3}
    loop = {r["node"]: r["depth"] for r in graph.layers(spark, spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"), spark.createDataFrame([("a",), ("z",)], "node string")).collect()}
    assert loop == {"a": 0, "b": 0, "z": 0} or loop == {"a": 1, "b": 1, "z": 0}


def test_prepared_tables_are_made_anew_when_their_files_change(spark, tmp_path):
    from changegraph.session import Stash, prepared

    made = []

    def make():
        made.append(1)
        return Stash(spark).put(spark.read.parquet(f"{tmp_path}/t.parquet"))

    ask = lambda: prepared(spark, str(tmp_path), "x", ("t",), make).count()
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert (ask(), ask(), len(made)) == (3, 3, 1)
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert (ask(), ask(), len(made)) == (5, 5, 2)
