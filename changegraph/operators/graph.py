"""Recursive questions over edges(src, dst): reach, shortest chains, layers, and what moved between two versions.

One semi-naive loop serves them all: a round joins the frontier with the edges, keeps the pairs not seen before and
writes them to the shared folder. A round costs one join and one anti-join of the frontier; earlier rounds are read as
they were written and never computed again. Where no path is asked for, a round goes over links of up to 2, 4, 8, ...
edges at once, as far as these stay few. Edges are expected to be distinct; null ends are ignored, self-loops
never add a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegraph.operators import ranges
from changegraph.session import Stash


#: Links over several edges may be so many times the edges themselves.
FAR = 30


def far_links(stash: Stash, links: DataFrame) -> tuple[DataFrame, int | None]:
    """src, dst, w: the shortest distance of every pair that lies at most a span apart, and the span; None if that is all pairs.

    The span doubles as long as the number of chains to be joined, known beforehand from the degrees, stays within FAR
    times the edges: graphs with hubs on both sides are left as they are."""
    far, span, most = stash.put(links.select("src", "dst", F.lit(1).alias("w"))), 1, FAR * stash.rows(links)
    while True:
        into = far.groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("i"))
        out = far.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("o"))
        if (into.join(out, "v").agg(F.sum(F.col("i") * F.col("o"))).first()[0] or 0) > most:
            return far, span
        on = far.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("w").alias("w2"))
        chains = far.join(on, "dst").filter("src <> to").select("src", F.col("to").alias("dst"), (F.col("w") + F.col("w2")).alias("w"))
        twice = stash.put(far.unionByName(chains).groupBy("src", "dst").agg(F.min("w").alias("w")))
        if stash.rows(twice) == stash.rows(far):
            return far, None
        stash.drop(far)
        far, span = twice, 2 * span


class Links:
    """Edges made ready for several questions: distinct, and with links over as many edges as stay few. `turned` is the same for the other direction."""

    def __init__(self, spark: SparkSession, edges: DataFrame):
        self.stash = Stash(spark)
        self.edges = self.stash.put(edges.select("src", "dst").dropna().filter("src <> dst").distinct())
        self.far, self.span = far_links(self.stash, self.edges)

    def turned(self) -> Links:
        other = object.__new__(Links)
        swap = [F.col("dst").alias("src"), F.col("src").alias("dst")]
        other.stash, other.span = self.stash, self.span
        other.edges, other.far = self.edges.select(*swap), self.far.select(*swap, "w")
        return other


def _leap(links: Links, start: DataFrame) -> DataFrame:
    """origin, node, depth by rounds that go a whole span of edges at once."""
    stash, far = links.stash, links.far
    frontier = start.select("origin", F.col("origin").alias("node"), F.lit(0).alias("depth"))
    rounds: list[DataFrame] = []
    while True:
        step = frontier.join(far, frontier["node"] == far["src"]).filter(F.col("dst") != F.col("origin"))
        found = step.groupBy("origin", F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        if rounds:
            found = found.join(stash.union(rounds).select("origin", "node"), ["origin", "node"], "left_anti")
        rounds.append(stash.put(found.select("origin", "node", "depth")))
        if links.span is None or not stash.rows(rounds[-1]):
            return stash.union(rounds)
        frontier = rounds[-1]


def reach(spark: SparkSession, edges: DataFrame | Links, origins: DataFrame, within: int | None = None, paths: bool = False) -> DataFrame:
    """origin, node, depth (1, 2, ...): every node that a chain of edges leads to from each origin, the origin left out even on a cycle.

    depth is that of the shortest chain. With paths, `path` is the array of nodes of a shortest chain, of those the one whose
    last but one node is smallest, and so on back. origins: a column `origin`; repeats and nulls don't count."""
    start = origins.select("origin").dropna().distinct()
    if within is None and not paths:
        return _leap(edges if isinstance(edges, Links) else Links(spark, edges), start)
    stash = Stash(spark)
    links = edges.edges if isinstance(edges, Links) else stash.put(edges.select("src", "dst").dropna().filter("src <> dst").distinct())
    frontier = start.select("origin", F.col("origin").alias("node"), F.array("origin").alias("path"))
    rounds: list[DataFrame] = []
    depth = 0
    while within is None or depth < within:
        depth += 1
        step = frontier.join(links, frontier["node"] == links["src"]).filter(F.col("dst") != F.col("origin"))
        found = step.groupBy("origin", F.col("dst").alias("node")).agg(F.min("src").alias("via"), *([F.min_by("path", "src").alias("path")] if paths else []))
        if rounds:
            found = found.join(stash.union(rounds).select("origin", "node"), ["origin", "node"], "left_anti")
        columns = ["origin", "node", F.lit(depth).alias("depth")] + ([F.concat("path", F.array("node")).alias("path")] if paths else [])
        new = stash.put(found.select(*columns))
        rounds.append(new)
        if not stash.rows(new):
            break
        frontier = new if paths else new.withColumn("path", F.array("origin"))
    return stash.union(rounds)


def callers(spark: SparkSession, edges: DataFrame | Links, nodes: DataFrame) -> DataFrame:
    """origin, node, depth: who reaches each of nodes (column `origin`)."""
    if isinstance(edges, Links):
        return reach(spark, edges.turned(), nodes)
    return reach(spark, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes)


def with_origin(reached: DataFrame, origins: DataFrame) -> DataFrame:
    """origin, node: reach that includes where it starts; reach itself never does."""
    return reached.select("origin", "node").unionByName(origins.select("origin", F.col("origin").alias("node")).dropna().distinct())


def avoiding(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """Edges that don't enter a node of blocked(node); an origin that is blocked itself still starts."""
    return edges.join(blocked.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")


def impact(spark: SparkSession, edges: DataFrame | Links, nodes: DataFrame, entries: DataFrame, flows: DataFrame) -> DataFrame:
    """node, endpoint, flow: the entry points, and their flows, from which each of nodes(origin) can be reached, or which it handles.

    entries(endpoint, handler); flows(endpoint, flow), an entry point without one is 'unplaced'."""
    above = with_origin(callers(spark, edges, nodes), nodes).select(F.col("origin").alias("of"), F.col("node").alias("handler"))
    met = above.join(entries.select("endpoint", "handler"), "handler").select(F.col("of").alias("node"), "endpoint").distinct()
    return met.join(flows, "endpoint", "left").select("node", "endpoint", F.coalesce("flow", F.lit("unplaced")).alias("flow"))


def reach_diff(spark: SparkSession, base: DataFrame, head: DataFrame, base_entries: DataFrame, head_entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """endpoint, node, moved ('gained' or 'lost'): nodes on both sides that an entry point reaches on one side only.

    Entry points are those of both sides; only the ones above a changed edge on either side are followed at all, as
    no other reach can have moved. entries(endpoint, handler), nodes(node)."""
    stash = Stash(spark)
    # both sides are one graph whose nodes bear their side in front, so each walk is made once
    on = lambda side, c: F.concat(F.lit(side), F.col(c) if isinstance(c, str) else c)
    bare = lambda c: F.expr(f"substring({c}, 2)")
    links = Links(spark, base.select(on("b", "src").alias("src"), on("b", "dst").alias("dst")).unionByName(head.select(on("h", "src").alias("src"), on("h", "dst").alias("dst"))))
    changed = links.edges.groupBy(bare("src").alias("src"), bare("dst").alias("dst")).agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    seeds = stash.put(changed.select("src").distinct().select(F.explode(F.array(on("b", "src"), on("h", "src"))).alias("origin")))
    above = with_origin(callers(spark, links, seeds), seeds).select(bare("node").alias("handler")).distinct()
    both = base_entries.select("endpoint", F.col("handler").alias("hb")).join(head_entries.select("endpoint", F.col("handler").alias("hh")), "endpoint")
    up = lambda c, n: above.select(F.col("handler").alias(c), F.lit(True).alias(n))
    moved = both.join(up("hb", "up_b"), "hb", "left").join(up("hh", "up_h"), "hh", "left").filter("up_b or up_h or hb <> hh")
    starts = stash.put(moved.select("endpoint", F.explode(F.array(on("b", "hb"), on("h", "hh"))).alias("origin")).dropna())
    got = starts.join(with_origin(reach(spark, links, starts), starts), "origin").select("endpoint", F.substring("origin", 1, 1).alias("side"), bare("node").alias("node")).distinct()
    met = got.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("endpoint", "node").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("side"))
    return met.filter("n = 1").select("endpoint", "node", F.when(F.col("side") == "h", "gained").otherwise("lost").alias("moved"))


def nearest_causes(spark: SparkSession, edges: DataFrame | Links, changed: DataFrame, moved: DataFrame) -> DataFrame:
    """node, src, dst: for each node that moved, the changed edges above it that have no other changed edge below them on the way to it.

    changed(src, dst) are edges of edges; moved(node)."""
    stash = Stash(spark)
    links = edges if isinstance(edges, Links) else Links(spark, edges)
    ch = stash.put(changed.select("src", "dst").distinct())
    starts = ch.select(F.col("dst").alias("origin")).distinct()
    below = stash.put(with_origin(reach(spark, links, starts), starts))  # from a changed edge's end on
    hit = below.join(moved.select("node").distinct(), "node", "left_semi").select(F.col("origin").alias("dst"), "node")
    on_way = stash.put(ch.join(hit, "dst").select("src", "dst", "node"))
    # another changed edge that starts below this one's end and also leads to the node
    inner = on_way.select(F.col("src").alias("s2"), F.col("dst").alias("d2"), "node")
    starts_below = below.select(F.col("origin").alias("dst"), F.col("node").alias("s2"))
    nearer = on_way.join(starts_below, "dst").join(inner, ["s2", "node"]).filter("not (src = s2 and dst = d2)").select("src", "dst", "node").distinct()
    return on_way.join(nearer, ["src", "dst", "node"], "left_anti").select("node", "src", "dst")


def bounded(spark: SparkSession, edges: DataFrame, origins: DataFrame, depth: int = 4, most: int = 22, skip: DataFrame | None = None) -> DataFrame:
    """origin, node, depth, hidden: the first `most` nodes by depth and name within `depth` steps, the origin counted, and how many are left out.

    Nodes of skip(node) are neither shown nor passed through."""
    e = avoiding(edges, skip) if skip is not None else edges
    got = reach(spark, e, origins, within=depth)
    n = got.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))
    first = ranges.first_in(got, ["origin"], ["depth", "node"], most - 1, "rn")
    return first.join(n, "origin").select("origin", "node", "depth", F.greatest(F.col("n") - (most - 1), F.lit(0)).alias("hidden"))


def _rings(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, ring: the nodes on cycles, and the smallest of those that each leads to and is led to by."""
    pairs = Links(spark, links)
    # a node on a cycle has links on both sides
    both = pairs.edges.select(F.col("src").alias("origin")).intersect(pairs.edges.select(F.col("dst").alias("origin")))
    there = Stash(spark).put(reach(spark, pairs, both).select("origin", "node"))
    back = there.select(F.col("node").alias("origin"), F.col("origin").alias("node"))
    mutual = there.join(back, ["origin", "node"], "left_semi")
    return mutual.groupBy(F.col("origin").alias("node")).agg(F.least(F.min("node"), F.col("origin")).alias("ring"))


def layers(spark: SparkSession, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, depth: length of the longest chain from a root(node), of the nodes that roots reach.

    Layers are peeled: a node's depth is final once all that lead to it are. Where none is left to peel, the nodes of each cycle
    are made one, so cycles count as single nodes, all of a cycle have its depth, and what lies behind goes on from there."""
    stash = Stash(spark)
    links = Links(spark, edges)
    starts = roots.select(F.col("node").alias("origin")).dropna().distinct()
    every = stash.put(with_origin(reach(spark, links, starts), starts).select("node").distinct())
    left = every
    links = stash.put(links.edges.join(every.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst"))
    done: list[DataFrame] = []
    rings = None
    while True:
        entered = links.select(F.col("dst").alias("node")).distinct()
        ready = stash.put(left.join(entered, "node", "left_anti").select("node", F.lit(len(done)).alias("depth")))
        if stash.rows(ready):
            done.append(ready)
            left = every.join(stash.union(done), "node", "left_anti").select("node")
            before, links = links, stash.put(links.join(ready.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst"))
            stash.drop(before)
            continue
        if not stash.rows(links):
            break
        rings = stash.put(_rings(spark, links))
        to = lambda c: F.coalesce(F.col(f"r{c}"), F.col(c)).alias(c)
        named = lambda c: rings.select(F.col("node").alias(c), F.col("ring").alias(f"r{c}"))
        whole = links.join(named("src"), "src", "left").join(named("dst"), "dst", "left").select(to("src"), to("dst")).filter("src <> dst").distinct()
        before, links = links, stash.put(whole)
        stash.drop(before)
        every = stash.put(every.join(rings.filter("node <> ring"), "node", "left_anti"))
        left = every.join(stash.union(done), "node", "left_anti").select("node") if done else every
    if not done:
        return every.select("node", F.lit(0).alias("depth"))
    out = stash.union(done)
    if rings is None:
        return out
    return out.unionByName(rings.filter("node <> ring").join(out.withColumnRenamed("node", "ring"), "ring").select("node", "depth"))


def ubiquitous(reached: DataFrame, share: float) -> DataFrame:
    """node: those reached from more than the share of all distinct origins."""
    total = reached.select("origin").distinct().count()
    return reached.groupBy("node").agg(F.countDistinct("origin").alias("n")).filter(F.col("n") > total * share).select("node")


def merges(spark: SparkSession, edges: DataFrame, steps: DataFrame, noise: DataFrame, got: DataFrame | None = None) -> DataFrame:
    """node, steps, flows: where the code of two or more flows first meets.

    steps(step, flow, handler). The set of steps that run a node is compared along edges: a node is kept if no caller has the
    identical set. Sets are compared by count and hash sum of their steps, so none is ever collected. noise(node) is skipped.
    got: origin, node, the reach of the handlers with themselves, where it is known already."""
    if got is None:
        starts = steps.select(F.col("handler").alias("origin"))
        got = with_origin(reach(spark, edges, starts), starts)
    ran = steps.join(got, steps["handler"] == got["origin"]).join(noise, "node", "left_anti").select("node", "step", "flow").distinct()
    sets = ran.groupBy("node").agg(F.countDistinct("step").alias("steps"), F.countDistinct("flow").alias("flows"), F.sum(F.xxhash64("step").cast("decimal(38,0)")).alias("h"))
    sets = Stash(spark).put(sets.filter("flows >= 2"))
    up = edges.select("src", F.col("dst").alias("node")).join(sets.select(F.col("node").alias("src"), F.col("steps").alias("s2"), F.col("h").alias("h2")), "src")
    same = sets.join(up, "node").filter("steps = s2 and h = h2").select("node").distinct()
    return sets.join(same, "node", "left_anti").select("node", "steps", "flows")


def connected(spark: SparkSession, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component: the smallest node that each of nodes(node) is linked with, whatever the direction; alone, its own.

    Each round every node hooks onto its smallest neighbour if that is smaller, the trees so made are folded to their roots
    by pointer jumping, and the links between roots go into the next round. At the end each node follows its hooks."""
    stash = Stash(spark)
    pairs = edges.select("src", "dst").dropna().filter("src <> dst")
    links = stash.put(pairs.union(pairs.select("dst", "src")).distinct())
    labels = nodes.select("node").dropna().union(links.select("src")).distinct().select("node", F.col("node").alias("component"))
    while stash.rows(links):
        hooks = stash.put(links.groupBy("src").agg(F.min("dst").alias("root")).filter("root < src"))
        while True:
            up = hooks.select(F.col("src").alias("root"), F.col("root").alias("top"))
            jumped, moved = stash.put_with(hooks.join(up, "root", "left").select("src", F.coalesce("top", "root").alias("root"), "top"), F.count("top").alias("moved"))
            hooks = jumped.select("src", "root")
            if not moved:
                break
        to_a, to_b = hooks.select("src", F.col("root").alias("ra")), hooks.select(F.col("src").alias("dst"), F.col("root").alias("rb"))
        folded = links.join(to_a, "src", "left").join(to_b, "dst", "left").select(F.coalesce("ra", "src").alias("src"), F.coalesce("rb", "dst").alias("dst"))
        links = stash.put(folded.filter("src <> dst").distinct())
        labels = stash.put(labels.join(hooks.select(F.col("src").alias("component"), "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component")))
    return labels
