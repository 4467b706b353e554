"""Change-impact queries: symbols, steps touched and reached, blind spots, verdict, lint, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegraph.functions import codec, paths
from changegraph.operators import graph, ranges
from changegraph.plans import views as V
from changegraph.plans.graphs import CHANGED_SQL, CLOSURE, HANDLED, changed_edges, handled_steps, reach_incl
from changegraph.plans.relational import CHANGED, changed_nodes
from changegraph.session import Stash
from changegraph.sources import facts
from changegraph.sources.tables import load

sql, QUERIES, ORACLES = V.sql, {}, {}
FACTS = {
    "j0": "SELECT DISTINCT ON (change_no) change_no, TRY_CAST(facts AS JSON) AS j FROM change_facts",
    "j1": "SELECT change_no, CASE WHEN json_type(j) = 'VARCHAR' THEN TRY_CAST(j ->> '$' AS JSON) ELSE j END AS j FROM j0",
    "rec": "SELECT change_no, coalesce(j -> 'facts', j) AS r FROM j1 WHERE j IS NOT NULL",
    "syms": "SELECT change_no, e.key::INT AS pos, e.value AS s FROM rec, json_each(r -> 'symbols') e",
    "fls": "SELECT change_no, e.key::INT AS pos, e.value AS f FROM rec, json_each(r -> 'files') e",
}


def query(oracle: str | None = None, recursive: str = "", with_facts: bool = False, **more: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle, recursive, **(FACTS if with_facts else {}), **more)
        return f

    return add


def recs(spark: SparkSession, d: str) -> DataFrame:
    return facts.records(load(spark, d, "change_facts", "change_no bigint, facts string"))


@query("SELECT change_no, s ->> 'id' AS id, s ->> 'status' AS status, (s ->> 'contract')::BOOLEAN AS contract, coalesce(json_array_length(s -> 'callers'), 0) AS callers, (s ->> 'kept_calls')::INT AS kept_calls FROM syms", with_facts=True)
def symbol_status(spark, d):
    n = F.coalesce(F.size("callers"), F.lit(0))
    return facts.symbols(recs(spark, d)).select("change_no", "id", "status", "contract", F.when(n > 0, n).otherwise(0).cast("bigint").alias("callers"), "kept_calls")


@query("SELECT change_no, count(*) AS symbols, count(*) FILTER (json_array_length(s -> 'signature') = 2 AND (s -> 'signature' ->> 0) <> (s -> 'signature' ->> 1)) AS new_signature FROM syms GROUP BY change_no", with_facts=True)
def contract_change(spark, d):
    s = facts.symbols(recs(spark, d))
    moved = (F.size("signature") == 2) & (F.get("signature", 0) != F.get("signature", 1))
    return s.groupBy("change_no").agg(F.count(F.lit(1)).alias("symbols"), F.count(F.when(moved, 1)).alias("new_signature"))


@query("SELECT change_no, count(*) AS files, sum((f ->> 'added')::INT)::BIGINT AS added, sum((f ->> 'removed')::INT)::BIGINT AS removed FROM fls GROUP BY change_no", with_facts=True)
def diff_stat(spark, d):
    return facts.files(recs(spark, d)).groupBy("change_no").agg(F.count(F.lit(1)).alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))


@query("SELECT change_no, CASE WHEN coalesce(json_array_length(r -> 'verdict' -> 'blind'), 0) > 0 THEN 'blind' WHEN coalesce(json_array_length(r -> 'verdict' -> 'spreads_to'), 0) > 0 THEN 'spreads' ELSE 'contained' END AS verdict FROM rec", with_facts=True)
def verdict(spark, d):
    """blind if any rule found a blind spot, else spreads if the change reaches further, else contained."""
    v = facts.field("verdict", facts.VERDICT)
    some = lambda c: F.coalesce(F.size(v[c]), F.lit(0)) > 0
    return recs(spark, d).select("change_no", F.when(some("blind"), "blind").when(some("spreads_to"), "spreads").otherwise("contained").alias("verdict"))


@query("SELECT r -> 'verdict' ->> 'verdict' AS said, CASE WHEN coalesce(json_array_length(r -> 'verdict' -> 'blind'), 0) > 0 THEN 'blind' WHEN coalesce(json_array_length(r -> 'verdict' -> 'spreads_to'), 0) > 0 THEN 'spreads' ELSE 'contained' END AS derived, count(*) AS n FROM rec GROUP BY ALL", with_facts=True)
def verdict_score(spark, d):
    """How often the verdict written down is the one that follows from its lists."""
    return recs(spark, d).select("change_no", facts.field("verdict.verdict", "string").alias("said")).join(verdict(spark, d), "change_no").groupBy("said", F.col("verdict").alias("derived")).agg(F.count(F.lit(1)).alias("n"))


RULES_SQL = """SELECT change_no, 'unread tests' AS rule FROM rec WHERE (r -> 'tests' ->> 'configured')::BOOLEAN IS NOT TRUE
UNION ALL SELECT DISTINCT change_no, 'code outside the graph' FROM fls WHERE f ->> 'kind' = 'outside'
UNION ALL SELECT DISTINCT change_no, 'module-level change' FROM syms WHERE ends_with(s ->> 'id', ':<module>')
UNION ALL SELECT DISTINCT change_no, 'deleted with callers' FROM syms WHERE s ->> 'status' = 'deleted' AND coalesce(json_array_length(s -> 'callers'), 0) > 0
UNION ALL SELECT change_no, 'no files' FROM rec WHERE coalesce(json_array_length(r -> 'files'), 0) = 0
UNION ALL SELECT change_no, 'entry point vanished' FROM rec WHERE coalesce(json_array_length(r -> 'endpoints' -> 'removed'), 0) > 0"""


@query(RULES_SQL, with_facts=True)
def blind_rules(spark, d):
    """One row per change and rule that finds something the analysis can't see."""
    r = Stash(spark).put(recs(spark, d).select("change_no", facts.field("tests.configured", "boolean").alias("tests"), facts.field("files", facts.FILES).alias("files"), facts.field("symbols", facts.SYMBOLS).alias("symbols"), facts.field("endpoints.removed", "array<string>").alias("removed")))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    rules = {
        "unread tests": ~F.coalesce("tests", F.lit(False)),
        "code outside the graph": F.exists("files", lambda f: f["kind"] == "outside"),
        "module-level change": F.exists("symbols", lambda s: F.endswith(s["id"], F.lit(":<module>"))),
        "deleted with callers": F.exists("symbols", lambda s: (s["status"] == "deleted") & (F.size(s["callers"]) > 0)),
        "no files": ~some("files"),
        "entry point vanished": some("removed"),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return r.select("change_no", F.explode(broken).alias("rule"))


@query(
    """SELECT change_no, 'no-symbols' AS code, 'change' AS subject FROM rec WHERE coalesce(json_array_length(r -> 'symbols'), 0) = 0
UNION ALL SELECT change_no, 'symbol-outside-diff', s ->> 'id' FROM syms WHERE (change_no, s ->> 'file') NOT IN (SELECT (change_no, f ->> 'path') FROM fls WHERE f ->> 'path' IS NOT NULL) AND s ->> 'file' IS NOT NULL
UNION ALL SELECT change_no, 'unknown-status', s ->> 'id' FROM syms WHERE coalesce(s ->> 'status', '') NOT IN ('new', 'deleted', 'modified')""",
    with_facts=True,
)
def lint_rules(spark, d):
    r = Stash(spark).put(recs(spark, d))
    s, f = facts.symbols(r), facts.files(r)
    none = r.select("change_no", F.coalesce(F.size(facts.field("symbols", facts.SYMBOLS)), F.lit(0)).alias("n")).filter("n <= 0").select("change_no", F.lit("no-symbols").alias("code"), F.lit("change").alias("subject"))
    outside = s.filter("file is not null").join(f.select("change_no", F.col("path").alias("file")), ["change_no", "file"], "left_anti").select("change_no", F.lit("symbol-outside-diff").alias("code"), F.col("id").alias("subject"))
    odd = s.filter(~F.coalesce("status", F.lit("")).isin("new", "deleted", "modified")).select("change_no", F.lit("unknown-status").alias("code"), F.col("id").alias("subject"))
    return none.unionByName(outside).unionByName(odd)


@query("SELECT steps, count(*) AS chapters, count(DISTINCT change_no) AS changes FROM (SELECT change_no, array_to_string(list_sort(list_distinct(from_json(s -> 'steps', '[\"VARCHAR\"]'))), ', ') AS steps FROM syms) WHERE steps <> '' GROUP BY steps", with_facts=True)
def auto_chapters(spark, d):
    """Symbols of a change with the identical steps make a chapter; here by their steps."""
    s = facts.symbols(recs(spark, d)).select("change_no", F.array_join(F.array_sort(F.array_distinct("steps")), ", ").alias("steps"))
    return s.filter("steps <> ''").groupBy("steps").agg(F.count(F.lit(1)).alias("chapters"), F.countDistinct("change_no").alias("changes"))


@query(f"SELECT DISTINCT step, node FROM (SELECT c.node, step FROM {CHANGED} c JOIN anchors a ON {V.f_('c.node')} = a.file AND {V.l_('c.node')} = a.leaf)")
def touched_steps(spark, d):
    from changegraph.plans.relational import anchor_join

    return anchor_join(spark, d).select("step", "node").distinct()


@query(f"SELECT node FROM {CHANGED} c WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE {V.f_('c.node')} = a.file AND {V.l_('c.node')} = a.leaf)")
def off_map(spark, d):
    c = changed_nodes(spark, d).select("node", paths.file_of("node").alias("file"), paths.leaf_of("node").alias("leaf"))
    return c.join(V.anchors(spark, d).select("file", "leaf"), ["file", "leaf"], "left_anti").select("node")


def reached_steps(spark: SparkSession, d: str) -> DataFrame:
    """node, step: the steps whose handlers reach each changed node."""
    ran = handled_steps(spark, d).join(reach_incl(spark, d), F.col("handler") == F.col("origin"))
    return ran.select("node", "step").distinct().join(changed_nodes(spark, d), "node", "left_semi").select("node", "step")


REACHED = f"(SELECT DISTINCT h.node, step FROM mends JOIN entries USING (endpoint) JOIN h ON handler = origin JOIN {CHANGED} c ON c.node = h.node)"


@query(f"SELECT node, step FROM {REACHED} r WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE a.step = r.step AND a.file = {V.f_('r.node')} AND a.leaf = {V.l_('r.node')})", recursive=HANDLED.format(e="edges"))
def hidden_steps(spark, d):
    """Steps that reach a changed node and don't name it."""
    return reached_steps(spark, d).join(touched_steps(spark, d), ["node", "step"], "left_anti")


@query(f"SELECT c.node, count(DISTINCT endpoint) AS endpoints, count(DISTINCT coalesce(flow, 'unplaced')) AS flows FROM {CHANGED} c JOIN h ON h.node = c.node JOIN entries ON handler = origin LEFT JOIN flow_of USING (endpoint) GROUP BY c.node", recursive=HANDLED.format(e="edges"))
def widest_reach(spark, d):
    flows = V.entries(spark, d).select("endpoint", F.col("handler").alias("origin")).join(V.flow_of(spark, d), "endpoint", "left").withColumn("flow", F.coalesce("flow", F.lit("unplaced")))
    met = reach_incl(spark, d).join(changed_nodes(spark, d), "node", "left_semi").join(flows, "origin")
    return met.groupBy("node").agg(F.countDistinct("endpoint").alias("endpoints"), F.countDistinct("flow").alias("flows"))


@query(f"SELECT c.node, count(DISTINCT endpoint) AS endpoints, count(DISTINCT coalesce(flow, 'unplaced')) AS flows FROM {CHANGED} c JOIN h ON h.node = c.node JOIN entries ON handler = origin LEFT JOIN flow_of USING (endpoint) GROUP BY c.node ORDER BY endpoints DESC, flows DESC, c.node DESC LIMIT 8", recursive=HANDLED.format(e="edges"))
def topk_widest(spark, d):
    return widest_reach(spark, d).orderBy(F.desc("endpoints"), F.desc("flows"), F.desc("node")).limit(8)


@query(f"SELECT step, CASE min(p) WHEN 1 THEN 'new' WHEN 2 THEN 'direct' ELSE 'reach' END AS kind FROM (SELECT step, 1 AS p FROM anchors WHERE node IN (SELECT src FROM head EXCEPT SELECT src FROM base) UNION ALL SELECT step, 2 FROM anchors a JOIN {CHANGED} c ON {V.f_('c.node')} = a.file AND {V.l_('c.node')} = a.leaf UNION ALL SELECT step, 3 FROM {REACHED}) GROUP BY step", recursive=HANDLED.format(e="edges"))
def overlay_kind(spark, d):
    """How a change shows on each step: it names a new node, or a changed one, or only reaches one."""
    from changegraph.plans.relational import anti_join

    new = V.anchors(spark, d).join(anti_join(spark, d), "node", "left_semi").select("step", F.lit(1).alias("p"))
    direct = touched_steps(spark, d).select("step", F.lit(2).alias("p"))
    every = new.union(direct).union(reached_steps(spark, d).select("step", F.lit(3)))
    return every.groupBy("step").agg(F.min("p").alias("p")).select("step", F.when(F.col("p") == 1, "new").when(F.col("p") == 2, "direct").otherwise("reach").alias("kind"))


@query(f"SELECT node, flow, arg_min(handler, (step, handler)) AS handler FROM (SELECT DISTINCT h.node, flow_id AS flow, step, handler FROM mends JOIN entries USING (endpoint) JOIN h ON handler = origin JOIN {CHANGED} c ON c.node = h.node) GROUP BY node, flow", recursive=HANDLED.format(e="edges"))
def first_witness(spark, d):
    """Of each flow the first step's first handler that reaches a changed node."""
    ran = handled_steps(spark, d).join(reach_incl(spark, d), F.col("handler") == F.col("origin")).join(changed_nodes(spark, d), "node", "left_semi")
    return ran.groupBy("node", "flow").agg(F.min_by("handler", F.struct("step", "handler")).alias("handler"))


@query("SELECT DISTINCT a.def_no FROM defs a WHERE a.alive AND a.start <= a.end_ AND EXISTS (SELECT 1 FROM defs b WHERE NOT b.alive AND b.file = a.file AND b.start <= b.end_ AND a.start <= b.end_ AND b.start <= a.end_)")
def range_overlap_semi(spark, d):
    """Live definitions whose lines overlap those of a deleted one in the same file."""
    g = V.defs(spark, d)
    dead = g.filter("not alive").select("file", F.col("start").alias("s2"), F.col("end").alias("e2"))
    return ranges.overlapping(g.filter("alive").select("def_no", "file", "start", "end"), dead, ["file"], "start", "end", "s2", "e2").select("def_no")


@query("SELECT file, line, count(*) AS covered FROM (SELECT file, unnest(generate_series(start, end_)) AS line FROM defs WHERE alive AND start <= end_) GROUP BY ALL HAVING count(*) > 1")
def hunk_line_explode(spark, d):
    """Line ranges unfolded to lines: the lines that more than one definition covers."""
    live = V.defs(spark, d).filter("alive and start <= end")
    return live.select("file", F.explode(F.sequence("start", "end")).alias("line")).groupBy("file", "line").agg(F.count(F.lit(1)).alias("covered")).filter("covered > 1")


@query("SELECT repo, kind, grp, count(*) AS lines FROM (SELECT repo, kind, sum(CASE WHEN handler IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY repo, kind ORDER BY entry_no ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM listings) GROUP BY ALL")
def sessionize_hunks(spark, d):
    """Rows belong to the last header before them: here rows of the inventory to the last one without a handler."""
    g = ranges.running_count(V.listings(spark, d).select("repo", "kind", "entry_no", "handler"), ["repo", "kind"], "entry_no", F.col("handler").isNull(), "grp")
    return g.groupBy("repo", "kind", "grp").agg(F.count(F.lit(1)).alias("lines"))


@query()
def pack_fragment(spark, d):
    """Each change's facts as a link's fragment, raw-deflated and in URL-safe base64; beyond the size of a link without diff
    text, that of files that aren't code first; null where even that doesn't fit."""
    f = load(spark, d, "change_facts", "change_no bigint, facts string").dropDuplicates(["change_no"]).filter("facts is not null")
    return f.select("change_no", codec.fitted_facts("facts").alias("fragment"))


@query("SELECT change_no, (r ->> 'flow_entropy')::DOUBLE AS said, coalesce(round(-sum(p * log2(p)), 2), 0) AS derived FROM (SELECT change_no, r, n / sum(n) OVER (PARTITION BY change_no) AS p FROM (SELECT change_no, r, e.value::INT AS n FROM rec, json_each(r -> 'flow_share') e)) GROUP BY ALL", with_facts=True)
def share_entropy(spark, d):
    """Entropy of a change's symbols over flows, against the figure written down."""
    r = recs(spark, d).select("change_no", facts.field("flow_entropy", "double").alias("said"), F.map_values(facts.field("flow_share", "map<string,int>")).alias("n")).filter("size(n) > 0")
    total = F.aggregate("n", F.lit(0), lambda a, x: a + x)
    bits = F.aggregate("n", F.lit(0.0), lambda a, x: a - x / F.col("t") * F.log2(x / F.col("t")))
    return r.withColumn("t", total).select("change_no", "said", F.round(bits, 2).alias("derived"))
