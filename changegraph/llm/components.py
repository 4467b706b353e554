"""Pairwise matches consolidated into groups: connected components by shrinking the graph.

Each round takes vertices away that have an obvious representative and remembers whom they follow:

1. leaves: a vertex with one neighbour follows it (of two such vertices that have only each other, the larger the smaller);
2. chains: runs of vertices with two neighbours are compressed by list ranking. Every directed link inside a run jumps
   over twice as many links each time, so a chain of L vertices takes log2(L) jumps; its vertices follow one of its ends,
   and the two ends become neighbours. A ring follows its smallest vertex;
3. core: in what is left every vertex has at least three neighbours. Each follows its neighbour of lowest priority (a hash
   that changes with the round) if that is lower than its own, the trees so made are folded to their roots by pointer
   jumping, and the graph of the roots goes into the next round. Three quarters of the vertices go in expectation.

Rounds go on until no link is left; the last FINISH links or fewer, where a round's jobs cost more than their work, are solved in
one task. At the end the vertices taken away get the label of the one they follow, last round first. All steps are aggregates
with partial combination and joins on vertices or pairs; nothing but counts reaches the driver, and these are taken while
tables are written. Each round's tables are written to the shared folder, and those no longer needed are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegraph.session import Stash

#: Every loop at least halves what is left in expectation; one that isn't done by then is an error.
MAX_ROUNDS = 200
#: Leaves are stripped as long as they are this share of the links.
MANY_LEAVES = 0.2
#: Links that one task may solve.
FINISH = 4096


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")


def _pairs(a, b, df: DataFrame) -> DataFrame:
    """Distinct undirected links without loops."""
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()


def _degrees(edges: DataFrame) -> DataFrame:
    """v, degree, lowest and highest neighbour: combined before the shuffle, no list of neighbours is ever made."""
    return _both(edges).groupBy("v").agg(F.count(F.lit(1)).alias("degree"), F.min("w").alias("lo"), F.max("w").alias("hi"))


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(F.least("v", "to").alias("a"), F.greatest("v", "to").alias("b")), ["a", "b"], "left_anti")


def _leaves(degrees: DataFrame) -> DataFrame:
    """v, to: vertices of one neighbour; both ends of a lone pair have one, then the smaller stays."""
    one = degrees.filter("degree = 1").select("v", F.col("lo").alias("to"))
    other = one.select(F.col("v").alias("to"), F.col("to").alias("v"), F.lit(True).alias("lone"))
    return one.join(other, ["v", "to"], "left").filter("lone is null or v > to").select("v", "to")


def _unsettled(what: str) -> RuntimeError:
    return RuntimeError(f"{what} didn't come to an end in {MAX_ROUNDS} rounds")


def _chains(stash: Stash, degrees: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(v, to) for the vertices of chains and rings, the links (a, b) between the ends of chains, and the table both are read from.

    A directed link (u, v) into a chain's vertex v goes on to (v, w), w being v's other neighbour; a link into a vertex
    outside of chains ends there. After k jumps a link knows where it is 2^k links on, and the smallest vertex on the way."""
    inner = degrees.filter("degree = 2").select("v", "lo", "hi")
    # links that leave an inner vertex, and what follows them if they lead to another one
    out = inner.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("lo").alias("v")), F.struct(F.col("v").alias("u"), F.col("hi").alias("v")))).alias("e")).select("e.u", "e.v")
    nxt = inner.select(F.col("v").alias("m"), "lo", "hi")
    links = out.join(nxt, out["v"] == nxt["m"], "left").select(
        "u", "v", F.when(F.col("m").isNotNull(), F.col("v")).alias("nu"), F.when(F.col("m").isNotNull(), F.when(F.col("lo") == F.col("u"), F.col("hi")).otherwise(F.col("lo"))).alias("nv"), F.col("v").alias("end"), F.least("u", "v").alias("low")
    )
    under_way = F.col("nu").isNotNull()
    measures = F.count(F.when(under_way, 1)).alias("n"), F.sum(F.when(under_way, F.xxhash64("low").cast("decimal(38,0)"))).alias("lows")
    links, *now = stash.put_with(links, *measures)
    seen: list | None = None
    for _ in range(MAX_ROUNDS):
        if not now[0] or now == seen:
            break  # no link is under way, or those that are go round in rings and have seen all of them
        ahead = links.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("mu"), F.col("nv").alias("mv"), F.col("end").alias("far"), F.col("low").alias("lower"))
        jumped = links.filter("nu is not null").join(ahead, ["nu", "nv"]).select("u", "v", F.col("mu").alias("nu"), F.col("mv").alias("nv"), F.col("far").alias("end"), F.least("low", "lower").alias("low"))
        before, seen = links, now
        links, *now = stash.put_with(links.filter("nu is null").unionByName(jumped), *measures)
        stash.drop(before)
    else:
        raise _unsettled("the ranking of chains")
    # the two directions of an inner vertex
    ends = links.groupBy("u").agg(F.min("end").alias("e1"), F.max("end").alias("e2"), F.min("low").alias("low"), F.max(F.col("nu").isNotNull()).alias("ring"))
    ends = stash.put(ends)
    stash.drop(links)
    gone = ends.filter("not ring or u <> low").select(F.col("u").alias("v"), F.when(F.col("ring"), F.col("low")).otherwise(F.col("e1")).alias("to"))
    return gone, _pairs(F.col("e1"), F.col("e2"), ends.filter("not ring")), ends


def _hook(stash: Stash, edges: DataFrame, turn: int) -> DataFrame:
    """v, to: each vertex of the core that has a neighbour of lower priority, and the root of its tree."""
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("x"))
    lowest = _both(edges).groupBy("v").agg(F.min(rank("w")).alias("w")).filter(F.col("w") < rank("v"))
    tree = stash.put(lowest.select("v", F.col("w.x").alias("to")))
    for _ in range(MAX_ROUNDS):
        up = tree.select(F.col("v").alias("to"), F.col("to").alias("root"))
        jumped, moved = stash.put_with(tree.select("v", "to").join(up, "to", "left").select("v", F.coalesce("root", "to").alias("to"), "root"), F.count("root").alias("moved"))
        stash.drop(tree)
        tree = jumped
        if not moved:
            return tree
    raise _unsettled("the folding of trees")


def _finished(edges: DataFrame) -> DataFrame:
    """v, to: the vertices of few links and the smallest vertex of each one's component, in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        arrow = pa.int64()
        for batch in batches:
            arrow = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        follow = [(v, root(v)) for v in parent if parent[v] != v]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in follow], arrow) for k in (0, 1)], names=["v", "to"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, f"v {kind}, to {kind}")


def components(spark: SparkSession, pairs: DataFrame, left: str, right: str) -> DataFrame:
    """vertex, component: every value of the two columns in a row where both are present, and the smallest vertex linked with it.

    Rows with a null on either side are no link; a pair of equal values makes a group of its own unless other links exist;
    reversed and repeated pairs count once; other columns are ignored. An empty table gives an empty one."""
    stash = Stash(spark)
    kind = pairs.schema[left].dataType
    links = pairs.select(F.col(left).alias("a"), F.col(right).cast(kind).alias("b")).dropna()
    loops = links.filter("a = b").select(F.col("a").alias("v")).distinct()
    edges = stash.put(_pairs(F.col("a"), F.col("b"), links))
    vertices = stash.put(_both(edges).select("v").unionByName(loops).distinct())
    taken: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        while stash.rows(edges) > FINISH:  # strip leaves as long as they are many
            leaves = stash.put(_leaves(_degrees(edges)))
            n_leaves, n = stash.rows(leaves), stash.rows(edges)
            if n_leaves:
                taken.append(leaves)
                before, edges = edges, stash.put(_without(edges, leaves))
                stash.drop(before)
            if n_leaves < MANY_LEAVES * n:
                break
        if stash.rows(edges) <= FINISH:
            if stash.rows(edges):
                taken.append(stash.put(_finished(edges)))
            break
        degrees, inner = stash.put_with(_degrees(edges), F.count(F.when(F.col("degree") == 2, 1)).alias("inner"))
        if inner:
            gone, between, ends = _chains(stash, degrees)
            taken.append(gone)
            inside = ends.select("u")
            # rings keep one vertex that has no link any more
            rest = edges.join(inside.select(F.col("u").alias("a")), "a", "left_anti").join(inside.select(F.col("u").alias("b")), "b", "left_anti").select("a", "b")
            before, edges = edges, stash.put(rest.unionByName(between).distinct())
            stash.drop(before)
        stash.drop(degrees)
        if stash.rows(edges) <= FINISH:
            continue
        roots = _hook(stash, edges, turn)
        taken.append(roots)
        to_a, to_b = roots.select(F.col("v").alias("a"), F.col("to").alias("ra")), roots.select(F.col("v").alias("b"), F.col("to").alias("rb"))
        folded = edges.join(to_a, "a", "left").join(to_b, "b", "left")
        before, edges = edges, stash.put(_pairs(F.coalesce("ra", "a"), F.coalesce("rb", "b"), folded))
        stash.drop(before)
    else:
        raise _unsettled("the shrinking of the graph")
    result = _restored(stash, vertices, taken)
    stash.keep(result)
    return result


def _restored(stash: Stash, vertices: DataFrame, taken: list[DataFrame]) -> DataFrame:
    """Labels from the last round back to the first, then the smallest vertex of each label.

    A vertex is taken in one round only, and whom it follows is taken later or never, so the labels of later rounds suffice."""
    labels: list[DataFrame] = []  # of those taken so far: v, label
    for gone in reversed(taken):
        if not labels:
            labels.append(stash.put(gone.select("v", F.col("to").alias("label"))))
            continue
        up = stash.union(labels).select(F.col("v").alias("to"), "label")
        labels.append(stash.put(gone.select("v", "to").join(up, "to", "left").select("v", F.coalesce("label", "to").alias("label"))))
    if not labels:
        return stash.put(vertices.select(F.col("v").alias("vertex"), F.col("v").alias("component")))
    full = stash.put(vertices.join(stash.union(labels), "v", "left").select("v", F.coalesce("label", "v").alias("label")))
    least = full.groupBy("label").agg(F.min("v").alias("component"))
    return stash.put(full.join(least, "label").select(F.col("v").alias("vertex"), "component"))
