"""Queries that hold a map and a change against the code: blind spots, verdicts, tested entry points, sound citations, and the orders of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changegraph.functions import names, paths, tidy
from changegraph.operators import blind, graph, ranges
from changegraph.operators import tested as tests
from changegraph.operators.nested import link, node_table
from changegraph.plans import views as V
from changegraph.plans.changes import FACTS, REACHED, off_map, overlay_kind, reached_steps, recs
from changegraph.plans.dealt import FACTS as NESTED
from changegraph.plans.graphs import CHANGED_SQL, CLOSURE, HANDLED, MERGES_SQL, changed_edges, component_matrix, handled_steps, longest_depth, merges, merges_sql, reach_diff, reach_incl, spread_union
from changegraph.plans.graphs import ORACLES as GRAPH_SQL
from changegraph.plans.relational import BASE_TIME, CHANGED, HEAD_TIME, LB, LH, changed_nodes, live_at, range_join_innermost
from changegraph.session import Stash
from changegraph.sources import facts
from changegraph.sources.config import Settings
from changegraph.sources.tables import load

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None, recursive: str = "", with_facts: bool = False, made: bool = False, **more: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle if made else V.sql(oracle, recursive, **(FACTS if with_facts else {}), **more)
        return f

    return add


# -- blind spots of each repository's change from its first revisions to its last; what the tables don't hold has a stand-in

#: Settings of this analysis, and the directories that stand in for migrations.
SETTINGS = Settings(app_dirs=["app", "src", "lib", "shared"], plumbing=["shared/config", "load"], split=["app"], vocabulary=[{"id": "read-a-meter", "proposed": ["new:read-meters", "new:meter-reading"]}, {"id": "return-a-loan", "proposed": "new:loans"}, {"id": "answer-a-ticket"}])
MIGRATED = "(^|/)(hooks|tasks)(_[^/]*)?/"


def _split(df: DataFrame, node: str = "node") -> DataFrame:
    """repo and node without it, of a node that bears its repository."""
    return df.withColumn("repo", F.substring_index(node, " ", 1)).withColumn(node, F.expr(f"substring({node}, length(repo) + 2)"))


def change_files(spark: SparkSession, d: str) -> DataFrame:
    """repo, path: files of changed nodes, and the documents of the repository."""
    code = _split(changed_nodes(spark, d)).select("repo", paths.file_of("node").alias("path"))
    docs = load(spark, d, "documents", "repo string, file_path string").select("repo", F.trim("file_path").alias("path")).filter("repo is not null and path <> ''")
    return code.unionByName(docs).distinct()


def spots(spark: SparkSession, d: str) -> DataFrame:
    """repo, rule, subject. Unparsed are files with a definition without lines, failed are sides at which a repository lists fewer
    than half of its entry points, module-level changes are lines the inventory names outside of all definitions, classes those of changed methods."""
    stash = Stash(spark)
    path = F.col("path")
    files = stash.put(change_files(spark, d).select("repo", "path", SETTINGS.kind(path).alias("kind"), F.endswith(path, F.lit(".py")).alias("graphed")))
    g = V.defs(spark, d).select(F.substring_index("node", " ", 1).alias("repo"), F.expr("substring(file, instr(file, ' ') + 1)").alias("path"), "start")
    bad = g.filter("start is null").select("repo", "path").distinct()
    ends = stash.put(V.listings(spark, d).select("repo", "endpoint").distinct().groupBy("repo").agg(F.count(F.lit(1)).alias("n")))
    sides = {"base": live_at(spark, d, BASE_TIME), "head": live_at(spark, d, HEAD_TIME)}
    live = {k: stash.put(df.withColumn("repo", F.substring_index("endpoint", " ", 1))) for k, df in sides.items()}
    few = lambda k: ends.join(live[k].groupBy("repo").agg(F.count(F.lit(1)).alias("m")), "repo", "left").filter("coalesce(m, 0) * 2 < n").select("repo", F.lit(k).alias("subject"))
    changed = stash.put(_split(changed_nodes(spark, d)).select("repo", paths.file_of("node").alias("path"), paths.symbol_of("node").alias("name")))
    outside = range_join_innermost(spark, d).filter("node = '<module>'").select("entry_no").join(V.changed_lines(spark, d), "entry_no").select(F.substring_index("file", " ", 1).alias("repo"), F.expr("substring(file, instr(file, ' ') + 1)").alias("path"), F.lit("<module>").alias("name"))
    classes = changed.filter(F.instr("name", ".") > 0).select("repo", "path", F.substring_index("name", ".", 1).alias("name"))
    symbols = changed.unionByName(outside).unionByName(classes).distinct().withColumn("status", F.lit("modified"))
    reached = _split(V.handler_reach(spark, d).select("node")).select("repo", paths.file_of("node").alias("path"), paths.symbol_of("node").alias("name")).distinct()
    heads = V.edges(spark, d, "head").select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("repo", F.substring_index("node", " ", 1))
    return blind.blind_spots(["repo"], files, bad, few("base").unionByName(few("head")), symbols, reached, live["base"], live["head"], heads, path.rlike(MIGRATED))


_KIND = f"CASE WHEN regexp_matches(path, '{paths.TEST}') THEN 'test' WHEN regexp_matches(path, '{paths.CODE}') THEN (CASE WHEN regexp_matches(path, '^(app|src|lib|shared)/') THEN 'code' WHEN regexp_matches(path, '{paths.DOC}') THEN 'doc' ELSE 'outside' END) WHEN starts_with(path, 'docs/map/') THEN 'generated' WHEN regexp_matches(path, '{paths.DOC}') THEN 'doc' ELSE 'outside' END"
_BARE = lambda c: f"substr({c}, instr({c}, ' ') + 1)"
SPOTS = {
    "chg": f"SELECT split_part(node, ' ', 1) AS repo, {V.f_(_BARE('node'))} AS path, {V.s_('node')} AS name FROM {CHANGED}",
    "cf0": "SELECT repo, path FROM chg UNION SELECT repo, trim(file_path) FROM documents WHERE repo IS NOT NULL AND trim(file_path) <> ''",
    "cf": f"SELECT repo, path, {_KIND} AS kind FROM cf0",
    "bad": f"SELECT DISTINCT split_part(node, ' ', 1) AS repo, {_BARE('file')} AS path FROM defs WHERE start IS NULL",
    "live_b": f"SELECT split_part(endpoint, ' ', 1) AS repo, * FROM {LB}",
    "live_h": f"SELECT split_part(endpoint, ' ', 1) AS repo, * FROM {LH}",
    "total": "SELECT repo, count(DISTINCT endpoint) AS n FROM listings GROUP BY repo",
    "codef": "SELECT * FROM cf WHERE kind = 'code'",
    "mig": f"SELECT * FROM codef WHERE regexp_matches(path, '{MIGRATED}')",
    "hit": "SELECT l.file, l.line, max(CASE WHEN l.line BETWEEN g.start AND g.end_ THEN 1 ELSE 0 END) AS inside FROM lines l LEFT JOIN (SELECT * FROM defs WHERE alive AND start <= end_) g ON g.file = l.file GROUP BY ALL",
    "modl": f"SELECT DISTINCT split_part(file, ' ', 1) AS repo, {_BARE('file')} AS path FROM hit WHERE inside = 0",
    "cls": f"SELECT DISTINCT repo, path, split_part(name, '.', 1) AS name FROM chg WHERE regexp_matches(split_part(name, '.', 1), '^\\p{{Lu}}')",
    "hnodes": "SELECT src AS node FROM head UNION SELECT dst FROM head",
    "spots": """SELECT repo, 'changed file can''t be parsed' AS rule, path AS subject FROM bad WHERE (repo, path) IN (SELECT (repo, path) FROM codef)
 UNION ALL SELECT repo, 'other file can''t be parsed', path FROM bad WHERE (repo, path) NOT IN (SELECT (repo, path) FROM codef)
 UNION ALL SELECT repo, 'inventory failed', 'base' FROM total WHERE 2 * (SELECT count(*) FROM live_b WHERE live_b.repo = total.repo) < n
 UNION ALL SELECT repo, 'inventory failed', 'head' FROM total WHERE 2 * (SELECT count(*) FROM live_h WHERE live_h.repo = total.repo) < n
 UNION ALL SELECT repo, 'migration', path FROM mig
 UNION ALL SELECT repo, 'module-level change', path FROM modl WHERE (repo, path) NOT IN (SELECT (repo, path) FROM mig)
 UNION ALL SELECT repo, 'class body without reach', path || ':' || name FROM cls WHERE (repo || ' ' || path || ':' || name) NOT IN (SELECT node FROM h WHERE node <> origin)
 UNION ALL SELECT repo, 'code without call graph', path FROM codef WHERE NOT ends_with(path, '.py')
 UNION ALL SELECT repo, 'outside of the analysis', path FROM cf WHERE kind = 'outside' AND NOT regexp_matches(path, '\\.(md|rst|txt|png|jpe?g|svg|gif)$|(^|/)(docs?|LICENSE)(/|$)', 'i')
 UNION ALL SELECT repo, 'entry point gone, handler still there', endpoint FROM live_b WHERE endpoint NOT IN (SELECT endpoint FROM live_h) AND handler IN (SELECT node FROM hnodes)""",
}
_SPOTS_WALK = ", ".join([HANDLED.format(e="edges"), *[f"{k} AS ({v})" for k, v in SPOTS.items()]])


@query("SELECT repo, rule, subject FROM spots", recursive=_SPOTS_WALK)
def blind_spots(spark, d):
    """The nine rules on each repository's change."""
    return spots(spark, d)


@query("SELECT rule, count(*) AS subjects, count(DISTINCT repo) AS repos FROM spots GROUP BY rule", recursive=_SPOTS_WALK)
def blind_summary(spark, d):
    return spots(spark, d).groupBy("rule").agg(F.count(F.lit(1)).alias("subjects"), F.countDistinct("repo").alias("repos"))


def change_verdict(spark: SparkSession, d: str) -> DataFrame:
    """repo, verdict: blind if a rule says so, else spreads if entry points or flows are reached, else contained; of the repositories with entry points."""
    dim = spots(spark, d).select("repo").distinct().withColumn("dim", F.lit(True))
    wide = spread_union(spark, d).select(F.substring_index("endpoint", " ", 1).alias("repo")).distinct().withColumn("wide", F.lit(True))
    repos = V.listings(spark, d).select("repo").distinct()
    return repos.join(dim, "repo", "left").join(wide, "repo", "left").select("repo", F.when(F.col("dim"), "blind").when(F.col("wide"), "spreads").otherwise("contained").alias("verdict"))


QUERIES["change_verdict"] = change_verdict
_spread = GRAPH_SQL["spread_union"]
_at = _spread.rindex("\nSELECT DISTINCT endpoint, flow FROM")
ORACLES["change_verdict"] = V.sql(
    f"SELECT repo, CASE WHEN repo IN (SELECT repo FROM spots) THEN 'blind' WHEN repo IN (SELECT split_part(endpoint, ' ', 1) FROM ({_spread[_at:]})) THEN 'spreads' ELSE 'contained' END AS verdict FROM (SELECT DISTINCT repo FROM listings)",
    recursive=", ".join([CLOSURE.format(e="edges"), _spread[_spread.index("hb(origin, node)") : _at], _SPOTS_WALK]),
)


# -- what tests name, what passes cite


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "repo string, text string").filter("repo is not null and text is not null")


def _listed(spark: SparkSession, d: str) -> DataFrame:
    e = V.listings(spark, d).filter("deleted_at is null").groupBy("repo", "endpoint").agg(F.min_by(F.struct("handler", "aliases"), F.struct("first_seen", "entry_no")).alias("x"))
    bare = lambda c: F.expr(f"substring({c}, length(repo) + 2)")
    return e.select("repo", bare("endpoint").alias("endpoint"), bare("x.handler").alias("handler"), F.col("x.aliases").alias("aliases"))


_Q = "''"
TESTED = {
    "te": f"SELECT repo, substr(endpoint, length(repo) + 2) AS endpoint, arg_min(substr(handler, length(repo) + 2), (first_seen, entry_no)) AS h0, arg_min(row(handler, aliases), (first_seen, entry_no)) AS x FROM listings WHERE deleted_at IS NULL GROUP BY ALL",
    "tk": f"SELECT repo, endpoint, split_part(endpoint, ' ', 1) AS kind, substr(endpoint, instr(endpoint, ' ') + 1) AS target, regexp_extract(substr(x[1], length(repo) + 2), '([^/]*?)(\\.py)?:[^:]*$', 1) AS module, list_distinct(list_filter(list_transform(coalesce(x[2], []), lambda a: {V.e_('a')}), lambda a: a IS NOT NULL)) AS aliases FROM te",
    "tp": """SELECT *, CASE WHEN kind = 'CLI' THEN CASE WHEN contains(target, ' ') THEN '\\b' || regexp_escape(module) || '\\.py\\b|\\bimport\\s+' || regexp_escape(module) || '\\b|[''"]' || regexp_escape(substr(target, instr(target, ' ') + 1)) || '[''"]' END
  WHEN kind = 'ACTION' THEN '\\b' || regexp_escape(string_split(target, '#')[-1]) || '\\b' WHEN starts_with(target, '/') THEN regexp_replace(regexp_escape(target), '\\\\\\{[^}]*\\}', '[^/"''`?\\\\s]+', 'g') || '([^\\w/]|$)' ELSE '[''"]' || regexp_escape(target) || '[''"]' END AS pat FROM tk""",
    "td": "SELECT repo, text FROM documents WHERE repo IS NOT NULL AND text IS NOT NULL",
    "hits": """SELECT DISTINCT tp.repo, endpoint FROM tp JOIN td ON tp.repo = td.repo WHERE regexp_matches(text, pat) OR len(list_filter(aliases, lambda a: CASE WHEN regexp_full_match(a, '\\w+') THEN regexp_matches(text, '\\b' || a || '\\b') ELSE regexp_matches(text, '[''"`]' || regexp_escape(a) || '[''"`]') END)) > 0""",
}


@query("SELECT repo, endpoint FROM hits", **TESTED)
def tested_endpoints(spark, d):
    """The entry points that the texts of their repository name, as tests would."""
    return tests.tested(_listed(spark, d), _texts(spark, d), ["repo"])


@query("SELECT kind, count(*) AS endpoints, count(*) FILTER ((repo, endpoint) IN (SELECT (repo, endpoint) FROM hits)) AS tested FROM tk GROUP BY kind", **TESTED)
def tested_share(spark, d):
    e = _listed(spark, d).select("repo", "endpoint")
    hit = tested_endpoints(spark, d).withColumn("hit", F.lit(True))
    return e.join(hit, ["repo", "endpoint"], "left").groupBy(paths.kind_of("endpoint").alias("kind")).agg(F.count(F.lit(1)).alias("endpoints"), F.count("hit").alias("tested"))


CITES = {
    "ce": f"SELECT DISTINCT repo, s.step_no AS place, {V.e_('v')} AS endpoint FROM (SELECT repo, s, unnest(s.endpoints) AS v FROM rsteps) WHERE {V.e_('v')} IS NOT NULL",
    "ca": f"SELECT DISTINCT repo, s.step_no AS place, {V.n_('v')} AS anchor FROM (SELECT repo, s, unnest(list_concat(coalesce(s.code_path, []), coalesce(s.ui, []))) AS v FROM rsteps) WHERE {V.n_('v')} IS NOT NULL",
    "kn": f"SELECT DISTINCT repo, substr(endpoint, length(repo) + 2) AS endpoint FROM listings UNION SELECT repo, {V.e_('v')} FROM (SELECT repo, unnest(aliases) AS v FROM listings) WHERE {V.e_('v')} IS NOT NULL",
    "df": f"SELECT DISTINCT split_part(node, ' ', 1) AS repo, {_BARE('file')} AS file, unnest(string_split(sym, '.')) AS part FROM defs",
    "cp": f"SELECT DISTINCT repo, place, anchor, {V.f_('anchor')} AS file, unnest(string_split({V.s_('anchor')}, '.')) AS part FROM ca WHERE contains(anchor, ':')",
}


def _cites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = V.runs(spark, d)
    cites = r.select("repo", F.col("step_no").alias("place"), F.explode(tidy.entries("endpoints")).alias("endpoint"))
    anchors = r.select("repo", F.col("step_no").alias("place"), F.explode(F.array_union(tidy.nodes("code_path"), tidy.nodes("ui"))).alias("anchor"))
    listed = V.listings(spark, d)
    known = listed.select("repo", F.explode(F.concat(F.array(F.expr("substring(endpoint, length(repo) + 2)")), "aliases")).alias("endpoint")).distinct()
    return cites, anchors, known


@query(
    "SELECT repo, place, 'unknown entry point' AS problem, endpoint AS subject FROM ce WHERE (repo, endpoint) NOT IN (SELECT (repo, endpoint) FROM kn) UNION SELECT repo, place, 'no symbol', anchor FROM ca WHERE NOT contains(anchor, ':') UNION SELECT repo, place, 'file missing', anchor FROM cp WHERE (repo, file) NOT IN (SELECT (repo, file) FROM df) UNION SELECT repo, place, 'symbol not defined', anchor FROM cp WHERE (repo, file) IN (SELECT (repo, file) FROM df) AND (repo, file, part) NOT IN (SELECT (repo, file, part) FROM df)",
    **CITES,
)
def pass_problems(spark, d):
    """What the steps of passes cite and isn't there: entry points, files, symbols."""
    cites, anchors, known = _cites(spark, d)
    g = Stash(spark).put(V.defs(spark, d).select(F.substring_index("node", " ", 1).alias("repo"), F.expr("substring(file, instr(file, ' ') + 1)").alias("file"), "sym").distinct())
    return tests.problems(cites, anchors, known, g.select("repo", "file").distinct(), g, ["repo"])


@query(
    "SELECT repo, area, run_id, endpoint FROM (SELECT DISTINCT repo, area, run_id FROM runs0) JOIN (SELECT DISTINCT repo, area, endpoint FROM pc) USING (repo, area) EXCEPT (SELECT repo, area, run_id, endpoint FROM pc UNION SELECT repo, area, run_id, e FROM un WHERE e IS NOT NULL)",
    pc=f"SELECT repo, area, run_id, {V.e_('v')} AS endpoint FROM (SELECT repo, area, run_id, unnest(s.endpoints) AS v FROM rsteps) WHERE {V.e_('v')} IS NOT NULL",
    un=f"SELECT repo, area, run_id, {V.e_('u.endpoint')} AS e FROM (SELECT repo, area, run_id, unnest(unplaced_endpoints) AS u FROM map_runs)",
)
def not_accounted(spark, d):
    """Of the entry points that the passes of an area place, those that a mapper neither places nor declares unplaced."""
    key = ["repo", "area", "run_id"]
    r = V.runs(spark, d).select(*key, F.explode(tidy.entries("endpoints")).alias("endpoint")).distinct()
    told = load(spark, d, "map_runs", "repo string, area string, run_id string, unplaced_endpoints array<struct<endpoint: string>>")
    declared = told.select(*key, F.explode(tidy.entries(F.transform("unplaced_endpoints", lambda u: u["endpoint"]))).alias("endpoint"))
    known = told.select(*key).distinct().join(r.select("repo", "area", "endpoint").distinct(), ["repo", "area"])  # a pass is over all of its area
    return tests.missing(known, r, declared, key)


# -- orders and layouts of reports

_MOVED = "(SELECT node, moved, count(*) AS n, node IN (SELECT node FROM anchors) AS anchor FROM ({0}) GROUP BY node, moved)"


def _reach_diff_sql(body: str) -> str:
    """The statement of reach_diff as a view of another one."""
    text = GRAPH_SQL["reach_diff"]
    at = text.rindex("\nSELECT endpoint, node, 'gained'")
    return V.sql(body, recursive=text[text.index("hb(origin, node)") : at] + f", rd AS ({text[at:]})")


@query(_reach_diff_sql(f"SELECT node, moved, n, anchor, row_number() OVER (PARTITION BY moved ORDER BY n DESC, NOT anchor, node) AS pos FROM {_MOVED.format('SELECT * FROM rd')} QUALIFY pos <= 10"), made=True)
def top_moved(spark, d):
    """The ten nodes that most entry points gained, and lost: anchors of steps before others of as many."""
    a = V.anchors(spark, d).select("node").distinct().withColumn("anchor", F.lit(True))
    n = reach_diff(spark, d).groupBy("node", "moved").agg(F.count(F.lit(1)).alias("n")).join(a, "node", "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    return ranges.first_in(n, ["moved"], [F.desc("n"), ~F.col("anchor"), "node"], 10)


@query(f"SELECT repo, change, src, dst, row_number() OVER (PARTITION BY repo, change ORDER BY src, dst) AS pos FROM (SELECT split_part(src, ' ', 1) AS repo, * FROM {CHANGED_SQL}) QUALIFY pos <= 8")
def first_edges(spark, d):
    """Of each repository the first eight calls that came, and that went."""
    e = changed_edges(spark, d).withColumn("repo", F.substring_index("src", " ", 1))
    return ranges.first_in(e, ["repo", "change"], ["src", "dst"], 8)


@query(
    f"SELECT file, coalesce(n, 0) AS importers, row_number() OVER (PARTITION BY split_part(file, ' ', 1) ORDER BY coalesce(n, 0) DESC, file) AS pos FROM (SELECT DISTINCT {V.f_('c.node')} AS file FROM {CHANGED} c WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE {V.f_('c.node')} = a.file AND {V.l_('c.node')} = a.leaf)) LEFT JOIN (SELECT {V.f_('dst')} AS file, count(DISTINCT {V.f_('src')}) AS n FROM edges WHERE {V.f_('src')} <> {V.f_('dst')} GROUP BY 1) USING (file)"
)
def off_map_files(spark, d):
    """Changed files that no step names, those first that most other files call."""
    f = off_map(spark, d).select(paths.file_of("node").alias("file")).distinct()
    e = V.edges(spark, d).select(paths.file_of("src").alias("by"), paths.file_of("dst").alias("file")).filter("by <> file")
    n = f.join(e.groupBy("file").agg(F.countDistinct("by").alias("n")), "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("importers"), F.substring_index("file", " ", 1).alias("repo"))
    return ranges.numbered(n, ["repo"], [F.desc("importers"), "file"], "pos").drop("repo")


_MATRIX = GRAPH_SQL["component_matrix"]
_AT = _MATRIX.rindex("\nSELECT component, flow")


def _matrix_sql(body: str) -> str:
    return f"{_MATRIX[:_AT]}, cm AS ({_MATRIX[_AT:]}), cs AS (SELECT component, count(*) AS flows, sum(steps)::BIGINT AS steps FROM cm GROUP BY component)\n{body}"


@query(_matrix_sql("SELECT component, flows, steps, row_number() OVER (ORDER BY flows DESC, steps DESC, component) AS pos FROM cs QUALIFY pos <= 6"), made=True)
def drawn_core(spark, d):
    """The six components that are drawn: the one of most flows and steps, the hub, first."""
    c = component_matrix(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("flows"), F.sum("steps").alias("steps"))
    top = c.orderBy(F.desc("flows"), F.desc("steps"), "component").limit(6)
    return top.select("component", "flows", "steps", F.row_number().over(Window.orderBy(F.desc("flows"), F.desc("steps"), "component")).alias("pos"))  # six rows


@query(_matrix_sql("SELECT component, flow, cm.steps, dense_rank() OVER (PARTITION BY flow ORDER BY flows DESC, component) AS row_no FROM cm JOIN cs USING (component)"), made=True)
def matrix_rows(spark, d):
    """The component matrix in the order it is shown: components of many flows first, for each flow."""
    m = Stash(spark).put(component_matrix(spark, d))
    n = m.groupBy("component").agg(F.count(F.lit(1)).alias("flows"))
    w = Window.partitionBy("flow").orderBy(F.desc("flows"), "component")
    return m.join(n, "component").select("component", "flow", "steps", F.dense_rank().over(w).alias("row_no"))


@query(
    "SELECT change_no, steps, symbols, row_number() OVER (PARTITION BY change_no ORDER BY k DESC, steps) AS chapter FROM (SELECT change_no, array_to_string(st, ', ') AS steps, len(st) AS k, count(*) AS symbols FROM (SELECT change_no, list_sort(list_distinct(coalesce(from_json(s -> 'steps', '[\"VARCHAR\"]'), []))) AS st FROM syms) GROUP BY change_no, st)",
    with_facts=True,
)
def chapters(spark, d):
    """The symbols of a change grouped by the steps that run them, groups of most steps first."""
    s = facts.symbols(recs(spark, d)).select("change_no", F.array_sort(F.array_distinct(F.coalesce("steps", F.array().cast("array<string>")))).alias("st"))
    g = s.groupBy("change_no", "st").agg(F.count(F.lit(1)).alias("symbols")).select("change_no", F.array_join("st", ", ").alias("steps"), F.size("st").alias("k"), "symbols")
    return ranges.numbered(g, ["change_no"], [F.desc("k"), "steps"], "chapter").drop("k")


@query("SELECT file, array_to_string(list_transform(list_sort(list((start, end_, sym))), lambda x: x[3]), ', ') AS outline FROM (SELECT DISTINCT file, start, end_, sym FROM defs WHERE alive AND start IS NOT NULL AND end_ IS NOT NULL) GROUP BY file")
def file_outline(spark, d):
    """What each file defines, in the order of lines. A file's definitions are one text's."""
    g = V.defs(spark, d).filter("alive and start is not null and end is not null").select("file", F.struct("start", "end", "sym").alias("s")).distinct()
    return g.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["sym"]), ", ").alias("outline"))


def column_layout(spark, d):
    """Where each node is drawn: its depth is the column, its place among the nodes of that depth the row."""
    n = longest_depth(spark, d).withColumn("repo", F.substring_index("node", " ", 1))
    return ranges.numbered(n, ["repo", "depth"], ["node"], "rn").select("node", "depth", (F.col("rn") - 1).alias("row_no"))


QUERIES["column_layout"] = column_layout
_DEPTH = GRAPH_SQL["longest_depth"]
_D_AT = _DEPTH.rindex("\nSELECT node, max(d)")
ORACLES["column_layout"] = f"{_DEPTH[:_D_AT]}, ld AS ({_DEPTH[_D_AT:]})\nSELECT node, depth, row_number() OVER (PARTITION BY split_part(node, ' ', 1), depth ORDER BY node) - 1 AS row_no FROM ld"


def merge_members(spark, d):
    """step, merges: in how many places where flows meet each step's code stands."""
    met = merges(spark, d).select("node")
    ran = handled_steps(spark, d).join(reach_incl(spark, d), F.col("handler") == F.col("origin")).select("step", "node").distinct()
    return ran.join(met, "node", "left_semi").groupBy("step").agg(F.count(F.lit(1)).alias("merges"))


QUERIES["merge_members"] = merge_members
ORACLES["merge_members"] = merges_sql("SELECT step, count(DISTINCT node) AS merges FROM ran WHERE node IN (SELECT node FROM met) GROUP BY step")


def merges_hit(spark: SparkSession, d: str) -> DataFrame:
    """node, hit: of each place where flows meet, how many changed nodes its code leads to, itself counted."""
    met = Stash(spark).put(merges(spark, d).select(F.col("node").alias("origin")))
    below = graph.with_origin(graph.reach(spark, V.links(spark, d), met), met)
    return below.join(changed_nodes(spark, d), "node", "left_semi").groupBy(F.col("origin").alias("node")).agg(F.count(F.lit(1)).alias("hit"))


QUERIES["merges_hit"] = merges_hit
ORACLES["merges_hit"] = V.sql(f"SELECT o AS node, count(*) AS hit FROM w WHERE n IN (SELECT node FROM {CHANGED}) GROUP BY o", recursive=", ".join([HANDLED.format(e="edges"), *[f"{k} AS ({v})" for k, v in MERGES_SQL.items()], "w(o, n) AS (SELECT node, node FROM met UNION SELECT w.o, x.dst FROM w JOIN edges x ON w.n = x.src)"]))


@query(f"SELECT flow_id, kind, count(DISTINCT step) AS steps FROM (SELECT step, CASE min(p) WHEN 1 THEN 'new' WHEN 2 THEN 'direct' ELSE 'reach' END AS kind FROM (SELECT step, 1 AS p FROM anchors WHERE node IN (SELECT src FROM head EXCEPT SELECT src FROM base) UNION ALL SELECT step, 2 FROM anchors a JOIN {CHANGED} c ON {V.f_('c.node')} = a.file AND {V.l_('c.node')} = a.leaf UNION ALL SELECT step, 3 FROM {REACHED}) GROUP BY step) JOIN (SELECT DISTINCT step, flow_id FROM msteps WHERE flow_id IS NOT NULL) USING (step) GROUP BY ALL", recursive=HANDLED.format(e="edges"))
def overlay_counts(spark, d):
    """How many steps of each flow a change shows on, by kind."""
    flow = V.map_steps(spark, d).select("step", "flow_id").dropna().distinct()
    return overlay_kind(spark, d).join(flow, "step").groupBy("flow_id", "kind").agg(F.countDistinct("step").alias("steps"))


@query(f"SELECT step, nodes, via FROM (SELECT step, count(DISTINCT node) AS nodes, array_to_string(list_slice(list_sort(list(DISTINCT {V.s_('node')})), 1, 4), ', ') AS via FROM {REACHED} GROUP BY step) ORDER BY nodes DESC, step LIMIT 6", recursive=HANDLED.format(e="edges"))
def overlay_widest(spark, d):
    """The six steps that reach most changed nodes, each with the first four names."""
    r = Stash(spark).put(reached_steps(spark, d))
    n = r.groupBy("step").agg(F.countDistinct("node").alias("nodes")).orderBy(F.desc("nodes"), "step").limit(6)
    via = ranges.first_in(r.join(n, "step").select("step", "nodes", paths.symbol_of("node").alias("s")).distinct(), ["step"], ["s"], 4)
    return via.groupBy("step", "nodes").agg(F.array_join(F.array_sort(F.collect_list("s")), ", ").alias("via"))


@query("SELECT step, hops, CAST(9 + least(12, round(1.1 * hops)) AS INTEGER) AS pin FROM (SELECT step, count(DISTINCT node) AS hops FROM anchors GROUP BY step)")
def pin_size(spark, d):
    n = V.anchors(spark, d).groupBy("step").agg(F.countDistinct("node").alias("hops"))
    return n.select("step", "hops", (9 + F.least(F.lit(12), F.round(F.col("hops") * 1.1))).cast("int").alias("pin"))


@query(f"SELECT repo, symbols / greatest(1, coalesce(steps, 0))::DOUBLE AS per_step FROM (SELECT split_part(node, ' ', 1) AS repo, count(*) AS symbols FROM {CHANGED} GROUP BY 1) LEFT JOIN (SELECT split_part(step, ' ', 1) AS repo, count(DISTINCT step) AS steps FROM {REACHED} GROUP BY 1) USING (repo)", recursive=HANDLED.format(e="edges"))
def symbols_per_step(spark, d):
    """How many changed symbols there are to each step that reaches one."""
    s = _split(changed_nodes(spark, d)).groupBy("repo").agg(F.count(F.lit(1)).alias("symbols"))
    t = reached_steps(spark, d).groupBy(F.substring_index("step", " ", 1).alias("repo")).agg(F.countDistinct("step").alias("steps"))
    return s.join(t, "repo", "left").select("repo", (F.col("symbols") / F.greatest(F.lit(1), F.coalesce("steps", F.lit(0)))).alias("per_step"))


@query(
    "SELECT id, array_to_string(list_sort(list(DISTINCT e)), ', ') AS endpoints FROM (SELECT s ->> 'id' AS id, unnest(ends) AS e FROM (SELECT change_no, s, unnest(from_json(s -> 'steps', '[\"VARCHAR\"]')) AS key FROM syms) JOIN mst USING (change_no, key)) WHERE e IS NOT NULL GROUP BY id",
    with_facts=True,
    mst="SELECT change_no, coalesce(st.value ->> 'key', st.key) AS key, CASE json_type(st.value -> 'endpoints') WHEN 'ARRAY' THEN list_transform((st.value -> 'endpoints')::JSON[], lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN x ->> 'endpoint' ELSE x ->> '$' END) WHEN 'VARCHAR' THEN [st.value ->> 'endpoints'] ELSE [] END AS ends FROM (SELECT change_no, f.value AS f FROM rec, json_each(r -> 'map') f WHERE f.type = 'OBJECT'), json_each(f -> 'steps') st WHERE st.type = 'OBJECT'",
)
def symbol_endpoints(spark, d):
    """Steps and their entry points turned round: the entry points that run each symbol, over all changes."""
    nodes = node_table(load(spark, d, "change_facts", "change_no bigint, facts string"), ["change_no"], "facts", NESTED)
    ends = link(nodes, ["change_no"], ["flow", "step", "endpoint"]).filter("endpoint_value is not null").select("change_no", F.col("step_name").alias("key"), F.col("endpoint_value").alias("e")).distinct()
    s = facts.symbols(recs(spark, d)).select("change_no", "id", F.explode("steps").alias("key"))
    met = s.join(ends, ["change_no", "key"]).select("id", "e").distinct()
    return met.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("e")), ", ").alias("endpoints"))


# -- names on pages, settings


@query("SELECT flow_id, upper(left(replace(t, '-', ' '), 1)) || lower(substr(replace(t, '-', ' '), 2)) AS title FROM (SELECT DISTINCT flow_id, CASE WHEN starts_with(flow_id, 'new:') THEN substr(flow_id, 5) ELSE flow_id END AS t FROM (SELECT flow.id AS flow_id FROM rflows)) WHERE flow_id IS NOT NULL")
def flow_titles(spark, d):
    m = load(spark, d, "map_runs", "flows array<struct<id: string>>").select(F.explode("flows.id").alias("flow_id")).dropna().distinct()
    return m.select("flow_id", names.flow_title("flow_id").alias("title"))


@query(f"SELECT DISTINCT node, coalesce(CASE WHEN starts_with(n, 'app/') THEN substr(n, 5) WHEN starts_with(n, 'src/') THEN substr(n, 5) WHEN starts_with(n, 'shared/') THEN substr(n, 8) END, n) AS short FROM (SELECT node, {_BARE('node')} AS n FROM defs)")
def short_nodes(spark, d):
    """Nodes without the app directory they lie in."""
    g = V.defs(spark, d).select("node", F.expr("substring(node, instr(node, ' ') + 1)").alias("n")).distinct()
    return g.select("node", paths.shortened("n", ["app", "src", "shared"]).alias("short"))


@query(f"SELECT u, string_split({V.f_('u')}, '/')[-2] AS grp FROM (SELECT DISTINCT {V.n_('v')} AS u FROM (SELECT unnest(ui) AS v FROM msteps)) WHERE contains(u, ':') AND contains({V.f_('u')}, '/')")
def screen_groups(spark, d):
    """The directory a screen is shown under."""
    u = V.map_steps(spark, d).select(F.explode(tidy.nodes("ui")).alias("u")).distinct().filter(F.contains("u", F.lit(":")) & F.contains(paths.file_of("u"), F.lit("/")))
    return u.select("u", names.screen_group("u").alias("grp"))


@query(
    f"SELECT DISTINCT node, array_to_string(list_slice(dirs, 1, CASE WHEN dirs[1] = 'app' THEN 2 ELSE 2 END), '/') AS component, (sym = 'load' OR leaf = 'load' OR starts_with(n, 'shared/config/')) AS plumbing FROM (SELECT node, sym, leaf, {_BARE('node')} AS n, string_split({V.f_(_BARE('node'))}, '/')[:-2] AS dirs FROM defs) WHERE len(dirs) >= 2"
)
def configured_components(spark, d):
    """The component of each node, and whether it is plumbing, by the settings."""
    g = V.defs(spark, d).select("node", F.expr("substring(node, instr(node, ' ') + 1)").alias("n")).distinct().filter(F.size(F.split(paths.file_of("n"), "/")) >= 3)
    return g.select("node", SETTINGS.component(F.col("n")).alias("component"), SETTINGS.is_plumbing(F.col("n")).alias("plumbing"))


@query("SELECT flow_id, CASE flow_id WHEN 'new:read-meters' THEN 'read-a-meter' WHEN 'new:meter-reading' THEN 'read-a-meter' WHEN 'new:loans' THEN 'return-a-loan' ELSE flow_id END AS flow, row_number() OVER (ORDER BY CASE flow_id WHEN 'read-a-meter' THEN 0 WHEN 'return-a-loan' THEN 1 WHEN 'answer-a-ticket' THEN 2 ELSE 3 END, flow_id) AS pos FROM (SELECT DISTINCT flow.id AS flow_id FROM rflows) WHERE flow_id IS NOT NULL")
def adopted_flows(spark, d):
    """Flows under the names they were adopted as, in the vocabulary's order. Flows are a bounded vocabulary, so one window orders them."""
    m = load(spark, d, "map_runs", "flows array<struct<id: string>>").select(F.explode("flows.id").alias("flow_id")).dropna().distinct()
    return m.select("flow_id", SETTINGS.adopt(F.col("flow_id")).alias("flow"), F.row_number().over(Window.orderBy(SETTINGS.flow_place(F.col("flow_id")), "flow_id")).alias("pos"))


@query(f"SELECT DISTINCT node, {_BARE('file')} || '#L' || start || '-L' || end_ AS place, end_ - start + 1 AS lines, regexp_matches(split_part(sym, '.', 1), '^\\p{{Lu}}') AND contains(sym, '.') AS is_method FROM defs WHERE alive AND start <= end_ AND node IN (SELECT node FROM anchors)")
def function_info(spark, d):
    """What is shown of the code that steps name: its place, its length, whether it belongs to a class."""
    g = V.defs(spark, d).filter("alive and start <= end").join(V.anchors(spark, d).select("node"), "node", "left_semi")
    place = F.concat(F.expr("substring(file, instr(file, ' ') + 1)"), F.lit("#L"), F.col("start").cast("string"), F.lit("-L"), F.col("end").cast("string"))
    return g.select("node", place.alias("place"), (F.col("end") - F.col("start") + 1).alias("lines"), (F.col("sym").rlike(r"^\p{Lu}") & F.contains("sym", F.lit("."))).alias("is_method")).distinct()


@query("SELECT DISTINCT x.src AS node, x.dst AS calls FROM edges x WHERE x.src IN (SELECT handler FROM entries) AND x.dst IN (SELECT node FROM noise) AND NOT regexp_matches(" + V.l_("x.dst") + ", '^\\p{Lu}')", recursive=HANDLED.format(e="edges") + ", noise AS (SELECT node FROM h GROUP BY node HAVING count(DISTINCT origin) >= 3)")
def also_calls(spark, d):
    """Nodes that very many handlers reach and so are not drawn, but are called directly by one that is; classes left out."""
    noise = reach_incl(spark, d).groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select(F.col("node").alias("dst"))
    e = V.edges(spark, d).join(V.handlers(spark, d).select(F.col("origin").alias("src")), "src", "left_semi").join(noise, "dst", "left_semi")
    return e.filter(~paths.leaf_of("dst").rlike(r"^\p{Lu}")).select(F.col("src").alias("node"), F.col("dst").alias("calls"))
