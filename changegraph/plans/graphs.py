"""Recursive queries over the call graph of both revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changegraph.functions import paths
from changegraph.operators import graph
from changegraph.plans import views as V
from changegraph.session import Stash

sql = V.sql
CLOSURE = "c(origin, node) AS (SELECT DISTINCT src, dst FROM {e} UNION SELECT c.origin, x.dst FROM c JOIN {e} x ON c.node = x.src WHERE c.origin <> x.dst)"
#: Reach of handlers only; `d` bounds the walk where depths are kept, and lies far above the longest shortest chain.
LEVELS = "lv(origin, node, d) AS (SELECT DISTINCT handler, handler, 0 FROM entries WHERE handler IS NOT NULL UNION SELECT lv.origin, x.dst, d + 1 FROM lv JOIN edges x ON lv.node = x.src WHERE d < 60)"
HANDLED = "h(origin, node) AS (SELECT DISTINCT handler, handler FROM entries WHERE handler IS NOT NULL UNION SELECT h.origin, x.dst FROM h JOIN {e} x ON h.node = x.src)"


def all_nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


def graph_callers(spark: SparkSession, d: str) -> DataFrame:
    """Who reaches each node that changed."""
    nodes = changed_edges(spark, d).select(F.col("src").alias("origin")).distinct()
    return graph.callers(spark, V.links(spark, d), nodes).select(F.col("origin").alias("node"), F.col("node").alias("caller"))


def graph_callees(spark: SparkSession, d: str) -> DataFrame:
    return V.handler_reach(spark, d).select(F.col("origin").alias("handler"), "node")


def reach_incl(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_origin(V.handler_reach(spark, d), V.handlers(spark, d))


def graph_reach_incl(spark: SparkSession, d: str) -> DataFrame:
    return reach_incl(spark, d).withColumnRenamed("origin", "handler")


def hubs(e: DataFrame) -> DataFrame:
    """node: of each repository the node with the most callers."""
    n = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).withColumn("repo", F.substring_index("node", " ", 1))
    return n.groupBy("repo").agg(F.max_by("node", F.struct("n", "node")).alias("node")).select("node")


def passages(e: DataFrame) -> DataFrame:
    """node: of each repository the node that is called and calls most: the most pairs of a caller and a callee."""
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"))
    out = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"))
    n = into.join(out, "node").select("node", (F.col("i") * F.col("o")).alias("n"), F.substring_index("node", " ", 1).alias("repo"))
    return n.groupBy("repo").agg(F.max_by("node", F.struct("n", "node")).alias("node")).select("node")


def reach_avoiding(spark: SparkSession, d: str) -> DataFrame:
    e = Stash(spark).put(V.edges(spark, d))
    return graph.reach(spark, graph.avoiding(e, hubs(e)), V.handlers(spark, d)).select(F.col("origin").alias("handler"), "node")


def shortest_path_len(spark: SparkSession, d: str) -> DataFrame:
    return V.handler_reach(spark, d).select(F.col("origin").alias("handler"), "node", "depth")


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    got = graph.reach(spark, V.links(spark, d), V.handlers(spark, d), paths=True)
    return got.select(F.col("origin").alias("handler"), "node", F.array_join("path", " > ").alias("chain"))


def changed_edges(spark: SparkSession, d: str) -> DataFrame:
    b, h = V.edges(spark, d, "base"), V.edges(spark, d, "head")
    return b.exceptAll(h).select("src", "dst", F.lit("removed").alias("change")).union(h.exceptAll(b).select("src", "dst", F.lit("added").alias("change")))


def impact(spark: SparkSession, d: str) -> DataFrame:
    changed = Stash(spark).put(changed_edges(spark, d))
    nodes = changed.select(F.col("src").alias("origin")).distinct()
    return graph.impact(spark, V.links(spark, d), nodes, V.entries(spark, d), V.flow_of(spark, d))


def _diff(spark: SparkSession, d: str) -> DataFrame:
    b, h = V.edges(spark, d, "base"), V.edges(spark, d, "head")
    e = V.entries(spark, d).select("endpoint", "handler").dropna()
    nodes = V.defs(spark, d).select("node").distinct()
    return graph.reach_diff(spark, b, h, e, e, nodes)


def reach_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)


def reach_diff_gained(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).filter("moved = 'gained'").select("endpoint", "node")


def reach_diff_lost(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).filter("moved = 'lost'").select("endpoint", "node")


DIFF_VIEWS = {
    "before": "SELECT DISTINCT endpoint, node FROM entries JOIN hb ON handler = origin WHERE node IN (SELECT node FROM defs)",
    "after": "SELECT DISTINCT endpoint, node FROM entries JOIN hh ON handler = origin WHERE node IN (SELECT node FROM defs)",
}
DIFF_WALK = ", ".join(f"{n}(origin, node) AS (SELECT DISTINCT handler, handler FROM entries WHERE handler IS NOT NULL UNION SELECT {n}.origin, x.dst FROM {n} JOIN {e} x ON {n}.node = x.src)" for n, e in (("hb", "base"), ("hh", "head")))


def diff_sql(body: str) -> str:
    return sql(body.replace("BEFORE", f"({DIFF_VIEWS['before']})").replace("AFTER", f"({DIFF_VIEWS['after']})"), recursive=DIFF_WALK)


def nearest_cause(spark: SparkSession, d: str) -> DataFrame:
    """The added edges that give each gained node its new reach."""
    added = changed_edges(spark, d).filter("change = 'added'").select("src", "dst")
    gained = _diff(spark, d).filter("moved = 'gained'").select("node").distinct()
    return graph.nearest_causes(spark, V.edges(spark, d, "head"), added, Stash(spark).put(gained))


def bounded_bfs(spark: SparkSession, d: str) -> DataFrame:
    return graph.bounded(spark, V.edges(spark, d), V.handlers(spark, d), depth=4, most=22).withColumnRenamed("origin", "handler")


def longest_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.layers(spark, V.edges(spark, d), V.handlers(spark, d).withColumnRenamed("origin", "node"))


def handled_steps(spark: SparkSession, d: str) -> DataFrame:
    """step, flow, handler: the steps of the latest maps and the handlers of their entry points."""
    m = V.map_endpoints(spark, d).select("step", F.col("flow_id").alias("flow"), "endpoint")
    return m.join(V.entries(spark, d).select("endpoint", "handler").dropna(), "endpoint").select("step", "flow", "handler").distinct()


def _merges(spark: SparkSession, d: str) -> DataFrame:
    got = Stash(spark).put(reach_incl(spark, d))
    return graph.merges(spark, V.edges(spark, d), handled_steps(spark, d), graph.ubiquitous(got, 0.5), got)


def merges(spark: SparkSession, d: str) -> DataFrame:
    return _merges(spark, d)


def topk_merges(spark: SparkSession, d: str) -> DataFrame:
    """The 24 files where most flows meet."""
    files = _merges(spark, d).groupBy(paths.file_of("node").alias("file")).agg(F.max("flows").alias("flows"), F.max("steps").alias("steps"), F.count(F.lit(1)).alias("nodes"))
    return files.orderBy(F.desc("flows"), F.desc("steps"), "file").limit(24)


MERGES_SQL = {
    "hs": "SELECT DISTINCT step, flow_id AS flow, handler FROM mends JOIN entries USING (endpoint) WHERE handler IS NOT NULL",
    "noise": "SELECT node FROM h GROUP BY node HAVING count(DISTINCT origin) > 0.5 * (SELECT count(DISTINCT origin) FROM h)",
    "ran": "SELECT DISTINCT node, step, flow FROM hs JOIN h ON handler = origin WHERE node NOT IN (SELECT node FROM noise)",
    "sets": "SELECT node, count(DISTINCT step) AS steps, count(DISTINCT flow) AS flows, list_sort(list(DISTINCT step)) AS s FROM ran GROUP BY node HAVING count(DISTINCT flow) >= 2",
    "met": "SELECT node, steps, flows FROM sets a WHERE NOT EXISTS (SELECT 1 FROM edges JOIN sets b ON b.node = src WHERE dst = a.node AND b.s = a.s)",
}


def merges_sql(body: str) -> str:
    text = body
    for k in reversed(MERGES_SQL):
        text = text.replace(f"<{k}>", k)
    return sql(text, recursive=", ".join([HANDLED.format(e="edges"), *[f"{k} AS ({v})" for k, v in MERGES_SQL.items()]]))


def ubiquity_filter(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that more than a quarter of a repository's handlers reach."""
    r = reach_incl(spark, d).withColumn("repo", F.substring_index("origin", " ", 1))
    total = r.groupBy("repo").agg(F.countDistinct("origin").alias("total"))
    n = r.groupBy("repo", "node").agg(F.countDistinct("origin").alias("handlers"))
    return n.join(total, "repo").filter(F.col("handlers") * 4 > F.col("total")).select("node", "handlers", "total")


def components_of(spark: SparkSession, d: str) -> DataFrame:
    """step, flow, component: the directories that the code of each step runs through."""
    got = reach_incl(spark, d)
    ran = handled_steps(spark, d).join(got, F.col("handler") == F.col("origin"))
    return ran.select("step", "flow", paths.area_of("node").alias("component")).distinct()


def step_components(spark: SparkSession, d: str) -> DataFrame:
    return components_of(spark, d).groupBy("step").agg(F.countDistinct("component").alias("components"))


def shared_components(spark: SparkSession, d: str) -> DataFrame:
    return components_of(spark, d).groupBy("component").agg(F.countDistinct("flow").alias("flows")).filter("flows >= 2")


def component_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of components and flows as rows: component, flow, steps. A cell without a row has no steps."""
    return components_of(spark, d).groupBy("component", "flow").agg(F.countDistinct("step").alias("steps"))


COMPONENTS_SQL = "comps AS (SELECT DISTINCT step, flow_id AS flow, array_to_string(string_split(node, '/')[1:2], '/') AS component FROM mends JOIN entries USING (endpoint) JOIN h ON handler = origin)"


def except_edges(spark: SparkSession, d: str) -> DataFrame:
    return changed_edges(spark, d)


def intersect_nodes(spark: SparkSession, d: str) -> DataFrame:
    return all_nodes(V.edges(spark, d, "base")).intersect(all_nodes(V.edges(spark, d, "head")))


def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return V.edges(spark, d, "base").union(V.edges(spark, d, "head")).distinct()


def module_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links between files that one side has and the other has not."""

    def links(side: str) -> DataFrame:
        e = V.edges(spark, d, side).select(paths.file_of("src").alias("src_file"), paths.file_of("dst").alias("dst_file"))
        return e.filter("src_file <> dst_file").distinct()

    b, h = links("base"), links("head")
    return h.subtract(b).withColumn("change", F.lit("added")).unionByName(b.subtract(h).withColumn("change", F.lit("removed")))


def spread_union(spark: SparkSession, d: str) -> DataFrame:
    """The flows a change spreads to: of the entry points above a changed edge, and of those whose reach moved."""
    touched = impact(spark, d).select("endpoint", "flow")
    moved = _diff(spark, d).select("endpoint").distinct().join(V.flow_of(spark, d), "endpoint", "left").select("endpoint", F.coalesce("flow", F.lit("unplaced")).alias("flow"))
    return touched.union(moved).distinct()


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    e = V.edges(spark, d)
    return graph.connected(spark, e, all_nodes(e))


def kept_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each node that both sides have."""
    both = V.edges(spark, d, "base").intersect(V.edges(spark, d, "head"))
    return both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("kept_calls"))


def hub_folding(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that a handler reaches only through its repository's busiest passage."""
    e = Stash(spark).put(V.edges(spark, d))
    h = Stash(spark).put(V.handlers(spark, d))
    every = V.handler_reach(spark, d).select("origin", "node")
    hub = Stash(spark).put(passages(e))
    free = graph.reach(spark, graph.avoiding(e, hub), h).select("origin", "node")
    return every.join(free, ["origin", "node"], "left_anti").join(hub, "node", "left_anti").select(F.col("origin").alias("handler"), "node")


def graph_size(spark: SparkSession, d: str) -> DataFrame:
    r = V.revised(spark, d).filter("dst is not null and src <> dst")
    return r.groupBy("side").agg(F.countDistinct("src", "dst").alias("edges"), F.countDistinct("src").alias("callers"), F.countDistinct("dst").alias("callees"))


HUB_SQL = "(SELECT arg_max(dst, (n, dst)) AS node FROM (SELECT dst, count(*) AS n, split_part(dst, ' ', 1) AS repo FROM edges GROUP BY dst) GROUP BY repo)"
PASSAGE_SQL = "(SELECT arg_max(node, (n, node)) AS node FROM (SELECT dst AS node, count(DISTINCT src) * (SELECT count(*) FROM edges y WHERE y.src = x.dst) AS n, split_part(dst, ' ', 1) AS repo FROM edges x GROUP BY dst) WHERE n > 0 GROUP BY repo)"
CHANGED_SQL = "(SELECT src, dst, 'added' AS change FROM head WHERE (src, dst) NOT IN (SELECT (src, dst) FROM base) UNION ALL SELECT src, dst, 'removed' FROM base WHERE (src, dst) NOT IN (SELECT (src, dst) FROM head))"
IMPACT_SQL = f"SELECT DISTINCT u.node AS node, endpoint, coalesce(flow, 'unplaced') AS flow FROM (SELECT origin AS up, node FROM c UNION SELECT src, src FROM edges) u JOIN (SELECT DISTINCT src AS node FROM {CHANGED_SQL}) s ON s.node = u.node JOIN entries ON handler = up LEFT JOIN flow_of USING (endpoint)"

QUERIES = {f.__name__: f for f in (graph_callers, graph_callees, graph_reach_incl, reach_avoiding, shortest_path_len, shortest_path, impact, reach_diff, reach_diff_gained, reach_diff_lost, nearest_cause, bounded_bfs, longest_depth, merges, topk_merges, ubiquity_filter, step_components, shared_components, component_matrix, except_edges, intersect_nodes, union_distinct, module_edges, spread_union, connected_components, kept_calls, hub_folding, graph_size)}

ORACLES = {
    "graph_callers": sql(f"SELECT node, origin AS caller FROM c WHERE node <> origin AND node IN (SELECT src FROM {CHANGED_SQL})", recursive=CLOSURE.format(e="edges")),
    "graph_callees": sql("SELECT origin AS handler, node FROM h WHERE origin <> node", recursive=HANDLED.format(e="edges")),
    "graph_reach_incl": sql("SELECT origin AS handler, node FROM h", recursive=HANDLED.format(e="edges")),
    "reach_avoiding": sql("SELECT origin AS handler, node FROM h WHERE origin <> node", recursive=f"free AS (SELECT * FROM edges WHERE dst NOT IN {HUB_SQL}), " + HANDLED.format(e="free")),
    "shortest_path_len": sql("SELECT origin AS handler, node, min(d) AS depth FROM lv WHERE origin <> node GROUP BY ALL", recursive=LEVELS),
    "shortest_path": sql(
        "SELECT origin AS handler, goal AS node, path AS chain FROM walk WHERE node = origin",
        recursive=LEVELS + ", best AS (SELECT origin, node, min(d) AS d FROM lv GROUP BY ALL), via AS (SELECT b.origin, b.node, min(p.node) AS parent FROM best b JOIN edges x ON x.dst = b.node JOIN best p ON p.origin = b.origin AND p.node = x.src AND p.d = b.d - 1 GROUP BY ALL), walk(origin, goal, node, path) AS (SELECT origin, node, node, node FROM best WHERE d > 0 UNION ALL SELECT walk.origin, goal, via.parent, via.parent || ' > ' || path FROM walk JOIN via ON via.origin = walk.origin AND via.node = walk.node WHERE walk.node <> walk.origin)",
    ),
    "impact": sql(IMPACT_SQL, recursive=CLOSURE.format(e="edges")),
    "reach_diff": diff_sql("SELECT endpoint, node, 'gained' AS moved FROM (SELECT * FROM AFTER EXCEPT SELECT * FROM BEFORE) UNION ALL SELECT endpoint, node, 'lost' FROM (SELECT * FROM BEFORE EXCEPT SELECT * FROM AFTER)"),
    "reach_diff_gained": diff_sql("SELECT * FROM AFTER EXCEPT SELECT * FROM BEFORE"),
    "reach_diff_lost": diff_sql("SELECT * FROM BEFORE EXCEPT SELECT * FROM AFTER"),
    "nearest_cause": diff_sql(
        "SELECT DISTINCT g.node, a.src, a.dst FROM (SELECT DISTINCT node FROM (SELECT * FROM AFTER EXCEPT SELECT * FROM BEFORE)) g, added a WHERE (a.dst = g.node OR EXISTS (SELECT 1 FROM c WHERE c.origin = a.dst AND c.node = g.node)) AND NOT EXISTS (SELECT 1 FROM added o WHERE NOT (o.src = a.src AND o.dst = a.dst) AND (o.src = a.dst OR EXISTS (SELECT 1 FROM c WHERE c.origin = a.dst AND c.node = o.src)) AND (o.dst = g.node OR EXISTS (SELECT 1 FROM c WHERE c.origin = o.dst AND c.node = g.node)))"
    ).replace("WITH RECURSIVE ", "WITH RECURSIVE ", 1),
    "bounded_bfs": sql("SELECT origin AS handler, node, d AS depth, greatest(n - 21, 0) AS hidden FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY d, node) AS rn, count(*) OVER (PARTITION BY origin) AS n FROM (SELECT origin, node, min(d) AS d FROM lv WHERE d <= 4 AND origin <> node GROUP BY ALL)) WHERE rn <= 21", recursive=LEVELS),
    "longest_depth": sql("SELECT node, max(d) AS depth FROM lv GROUP BY node", recursive=LEVELS),
    "merges": merges_sql("SELECT * FROM met"),
    "topk_merges": merges_sql("SELECT regexp_extract(node, '^(.*):[^:]*$', 1) AS file, max(flows) AS flows, max(steps) AS steps, count(*) AS nodes FROM met GROUP BY 1 ORDER BY flows DESC, steps DESC, file LIMIT 24"),
    "ubiquity_filter": sql("SELECT node, handlers, total FROM (SELECT split_part(origin, ' ', 1) AS repo, node, count(DISTINCT origin) AS handlers FROM h GROUP BY ALL) JOIN (SELECT split_part(origin, ' ', 1) AS repo, count(DISTINCT origin) AS total FROM h GROUP BY 1) USING (repo) WHERE handlers * 4 > total", recursive=HANDLED.format(e="edges")),
    "step_components": sql("SELECT step, count(DISTINCT component) AS components FROM comps GROUP BY step", recursive=HANDLED.format(e="edges") + ", " + COMPONENTS_SQL),
    "shared_components": sql("SELECT component, count(DISTINCT flow) AS flows FROM comps GROUP BY component HAVING count(DISTINCT flow) >= 2", recursive=HANDLED.format(e="edges") + ", " + COMPONENTS_SQL),
    "component_matrix": sql("SELECT component, flow, count(DISTINCT step) AS steps FROM comps GROUP BY component, flow", recursive=HANDLED.format(e="edges") + ", " + COMPONENTS_SQL),
    "except_edges": sql(f"SELECT * FROM {CHANGED_SQL}"),
    "intersect_nodes": sql("(SELECT src AS node FROM base UNION SELECT dst FROM base) INTERSECT (SELECT src FROM head UNION SELECT dst FROM head)"),
    "union_distinct": sql("SELECT * FROM base UNION SELECT * FROM head"),
    "module_edges": sql("SELECT *, 'added' AS change FROM (SELECT * FROM hf EXCEPT SELECT * FROM bf) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM bf EXCEPT SELECT * FROM hf)", **{n: f"SELECT DISTINCT {V.f_('src')} AS src_file, {V.f_('dst')} AS dst_file FROM {t} WHERE {V.f_('src')} <> {V.f_('dst')}" for n, t in (("bf", "base"), ("hf", "head"))}),
    "spread_union": diff_sql(f"SELECT DISTINCT endpoint, flow FROM ({IMPACT_SQL}) UNION SELECT endpoint, coalesce(flow, 'unplaced') FROM ((SELECT * FROM AFTER EXCEPT SELECT * FROM BEFORE) UNION (SELECT * FROM BEFORE EXCEPT SELECT * FROM AFTER)) LEFT JOIN flow_of USING (endpoint)"),
    "connected_components": sql("SELECT v AS node, min(w) AS component FROM cc GROUP BY v", recursive="both_ AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), cc(v, w) AS (SELECT a, a FROM both_ UNION SELECT cc.v, both_.b FROM cc JOIN both_ ON cc.w = both_.a)"),
    "kept_calls": sql("SELECT src AS node, count(*) AS kept_calls FROM (SELECT * FROM base INTERSECT SELECT * FROM head) GROUP BY src"),
    "hub_folding": sql(f"SELECT h.origin AS handler, h.node FROM h ANTI JOIN g ON g.origin = h.origin AND g.node = h.node WHERE h.node NOT IN {PASSAGE_SQL}", recursive=f"free AS (SELECT * FROM edges WHERE dst NOT IN {PASSAGE_SQL}), " + HANDLED.format(e="edges") + ", " + HANDLED.format(e="free").replace("h(", "g(").replace("h.", "g.").replace("FROM h ", "FROM g ")),
    "graph_size": sql("SELECT side, count(DISTINCT (src, dst)) AS edges, count(DISTINCT src) AS callers, count(DISTINCT dst) AS callees FROM revised WHERE dst IS NOT NULL AND src <> dst GROUP BY side"),
}
for _k, _walk in (("nearest_cause", "added AS (SELECT src, dst FROM head EXCEPT SELECT src, dst FROM base), " + CLOSURE.format(e="head")), ("spread_union", CLOSURE.format(e="edges"))):
    _body = ORACLES[_k]
    _at = _body.index("hb(origin, node)")
    ORACLES[_k] = _body[:_at] + _walk + ", " + _body[_at:]
