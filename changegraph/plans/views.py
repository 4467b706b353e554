"""The relations all queries start from, in Spark and, under the same names, in the oracle's SQL.

Nodes and entry points carry their repository in front (`repo node`), as the same path in two repositories is two things.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changegraph.functions import paths, tidy
from changegraph.operators import graph
from changegraph.session import Stash, prepared
from changegraph.sources.tables import flatten_steps, load, load_steps


def _in_repo(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat_ws(" ", F.col("repo"), c))


def revised(spark: SparkSession, d: str) -> DataFrame:
    """repo, area, side ('base' or 'head'), src, dst: the edges of each area's first and last revision; dst may be null."""
    e = load(spark, d, "graph_edges", "repo string, ref_sha string, src string, dst string, seen_at timestamp_ntz")
    e = e.select("repo", "ref_sha", "seen_at", tidy.node("src").alias("s"), tidy.node("dst").alias("t")).withColumn("area", paths.area_of("s"))
    seen = e.groupBy("repo", "area", "ref_sha").agg(F.min("seen_at").alias("first"), F.max("seen_at").alias("last"))
    ends = seen.groupBy("repo", "area").agg(F.min(F.struct("first", "ref_sha")).alias("b"), F.max(F.struct("last", "ref_sha")).alias("h"))
    sides = ends.select("repo", "area", F.explode(F.array(F.struct(F.lit("base").alias("side"), F.col("b.ref_sha").alias("ref_sha")), F.struct(F.lit("head").alias("side"), F.col("h.ref_sha").alias("ref_sha")))).alias("x"))
    sides = sides.select("repo", "area", "x.side", "x.ref_sha")
    return e.join(sides, ["repo", "area", "ref_sha"]).select("repo", "area", "side", _in_repo(F.col("s")).alias("src"), _in_repo(F.col("t")).alias("dst")).distinct()


def edges(spark: SparkSession, d: str, side: str | None = None) -> DataFrame:
    """src, dst: distinct calls of one side or of both, self-calls and unresolved ones left out."""

    def made() -> DataFrame:
        return Stash(spark).put(revised(spark, d).filter("dst is not null and src <> dst").select("side", "src", "dst").distinct())

    r = prepared(spark, d, "edges", ("graph_edges",), made)
    return r.filter(F.col("side") == side).select("src", "dst") if side else r.select("src", "dst").distinct()


def links(spark: SparkSession, d: str) -> graph.Links:
    """The calls of both sides, made ready for questions of reach."""
    return prepared(spark, d, "links", ("graph_edges",), lambda: graph.Links(spark, edges(spark, d)))


def handler_reach(spark: SparkSession, d: str) -> DataFrame:
    """origin, node, depth: what the handlers of the entry points reach."""
    return prepared(spark, d, "handler_reach", ("graph_edges", "inventory"), lambda: Stash(spark).put(graph.reach(spark, links(spark, d), handlers(spark, d))))


def handlers(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select(F.col("handler").alias("origin")).dropna().distinct()


def defs(spark: SparkSession, d: str) -> DataFrame:
    """node, file (with its repo), sym, leaf, start, end, alive: each definition once."""
    g = load(spark, d, "graph_defs", "def_no bigint, repo string, node string, start_line int, end_line int, deleted_at timestamp_ntz").dropDuplicates(["def_no"])
    g = g.withColumn("n", tidy.node("node")).filter("n is not null")
    return g.select("def_no", _in_repo(F.col("n")).alias("node"), _in_repo(paths.file_of("n")).alias("file"), paths.symbol_of("n").alias("sym"), paths.leaf_of("n").alias("leaf"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("deleted_at").isNull().alias("alive"))


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the inventory once, tidied: entry_no, repo, endpoint, kind, handler, line, aliases, implicit, first_seen, deleted_at."""
    i = load(spark, d, "inventory").dropDuplicates(["entry_no"])
    i = i.withColumn("e", tidy.entry("endpoint")).filter("e is not null")
    return i.select("entry_no", "repo", _in_repo(F.col("e")).alias("endpoint"), paths.kind_of("e").alias("kind"), _in_repo(tidy.node("handler")).alias("handler"), F.col("line_no").alias("line"), tidy.entries("aliases").alias("aliases"), "implicit", "first_seen", "deleted_at")


def entries(spark: SparkSession, d: str) -> DataFrame:
    """entry_no, endpoint, kind, handler, line: of the live rows the first seen of each entry point."""
    live = listings(spark, d).filter("deleted_at is null").groupBy("endpoint").agg(F.min(F.struct("first_seen", "entry_no", "kind", "handler", "line")).alias("r"))
    return live.select("r.entry_no", "endpoint", "r.kind", "r.handler", "r.line")


MAP_STEP = "id: string, step_name: string, alt_names: array<string>, actor: string, endpoints: array<string>, ui: array<string>, code_path: array<string>, writes: array<string>, evidence: string, untested_endpoints: array<string>, runs: array<string>"


def map_steps(spark: SparkSession, d: str) -> DataFrame:
    """One row per step of the latest map of each area: repo, area, map_no, flow_pos, flow_id, summary, step_pos, step_id, step (repo flow/step) and its fields."""
    m = load(spark, d, "flow_maps", f"map_no bigint, repo string, area string, made_at timestamp_ntz, agree_threshold int, flows array<struct<id: string, summary: string, steps: array<struct<{MAP_STEP}>>>>")
    # which map is the last one is known from the numbers alone; the flows of the others are never shuffled
    last = m.groupBy("repo", "area").agg(F.max(F.struct("made_at", "map_no")).alias("r")).select("repo", "area", "r.map_no")
    latest = m.join(last, ["repo", "area", "map_no"], "left_semi").dropDuplicates(["repo", "area", "map_no"])
    flow = latest.select("map_no", "repo", "area", "agree_threshold", F.posexplode("flows").alias("flow_pos", "flow"))
    step = flow.select("map_no", "repo", "area", "agree_threshold", "flow_pos", F.col("flow.id").alias("flow_id"), F.posexplode("flow.steps").alias("step_pos", "s"))
    step = step.filter("s is not null")
    return step.select("map_no", "repo", "area", "agree_threshold", "flow_pos", "flow_id", "step_pos", F.col("s.id").alias("step_id"), F.concat_ws(" ", "repo", F.concat_ws("/", "flow_id", F.col("s.id"))).alias("step"), *[F.col(f"s.{c}").alias(c) for c in ("step_name", "alt_names", "actor", "endpoints", "ui", "code_path", "writes", "evidence", "runs")])


def map_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """repo, flow_id, step, map_no, flow_pos, step_pos, endpoint: the entry points of the steps of the latest maps."""
    s = map_steps(spark, d).select("repo", "flow_id", "step", "map_no", "flow_pos", "step_pos", F.explode(tidy.entries("endpoints")).alias("e"))
    return s.select("repo", "flow_id", "step", "map_no", "flow_pos", "step_pos", _in_repo(F.col("e")).alias("endpoint")).distinct()


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """step, flow_id, node, file, leaf: the node ids of the steps' code paths in the latest maps."""
    s = map_steps(spark, d).select("repo", "flow_id", "step", F.explode(tidy.nodes("code_path")).alias("n"))
    return s.select("step", "flow_id", _in_repo(F.col("n")).alias("node"), _in_repo(paths.file_of("n")).alias("file"), paths.leaf_of("n").alias("leaf")).distinct()


def flow_of(spark: SparkSession, d: str) -> DataFrame:
    """endpoint, flow: of an entry point in several steps the last."""
    w = F.struct("map_no", "flow_pos", "step_pos", "flow_id")
    return map_endpoints(spark, d).groupBy("endpoint").agg(F.max_by("flow_id", w).alias("flow"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """The steps of all passes, each once: repo, area, run_id, flow_id, pass_no, flow_pos, step_pos, step_no and its fields."""
    return load_steps(spark, d, "id", "step_name", "actor", "endpoints", "ui", "code_path", "writes").dropDuplicates(["step_no"])


def placements(spark: SparkSession, d: str) -> DataFrame:
    """scope (repo area), endpoint, run_id, flow_id, step_no, pos: each mapper's first placement of each entry point, in the order of pass, flow and step."""
    p = load_steps(spark, d, "endpoints").select("repo", "area", "run_id", "flow_id", "step_no", F.struct("pass_no", "flow_pos", "step_pos").alias("pos"), F.explode(tidy.entries("endpoints")).alias("e"))
    p = p.select(F.concat_ws(" ", "repo", "area").alias("scope"), _in_repo(F.col("e")).alias("endpoint"), "run_id", "flow_id", "step_no", "pos")
    return p.groupBy("scope", "endpoint", "run_id").agg(F.min(F.struct("pos", "flow_id", "step_no")).alias("first")).select("scope", "endpoint", "run_id", "first.flow_id", "first.step_no", "first.pos")


def changed_lines(spark: SparkSession, d: str) -> DataFrame:
    """file, line, entry_no: the lines that the inventory names, as places to be looked up among definitions."""
    rows = listings(spark, d).filter("handler is not null and line is not null")
    return rows.select("entry_no", paths.file_of("handler").alias("file"), paths.leaf_of("handler").alias("leaf"), "line")


def _tidy(template: str, c: str) -> str:
    return template.replace("{0}", c)


ENTRY = "nullif(upper(split_part(regexp_replace(trim({0}), '\\s+', ' ', 'g'), ' ', 1)) || substr(regexp_replace(trim({0}), '\\s+', ' ', 'g'), length(split_part(regexp_replace(trim({0}), '\\s+', ' ', 'g'), ' ', 1)) + 1), '')"
NODE = "nullif(regexp_replace(replace(trim({0}), '\\', '/'), '^\\./', ''), '')"
FILE = "regexp_extract({0}, '^(.*):[^:]*$', 1)"
LEAF = "regexp_extract({0}, '([^.:]*)$', 1)"
SYM = "regexp_extract({0}, '([^:]*)$', 1)"
e_, n_, f_, l_, s_ = (lambda c, t=t: _tidy(t, c) for t in (ENTRY, NODE, FILE, LEAF, SYM))

#: name -> (the views it needs, its text)
SQL: dict[str, str] = {
    "e0": f"SELECT DISTINCT repo, ref_sha, seen_at, {n_('src')} AS s, {n_('dst')} AS t FROM graph_edges",
    "e1": "SELECT *, array_to_string(string_split(s, '/')[1:2], '/') AS area FROM e0",
    "ends": "SELECT repo, area, arg_min(ref_sha, (seen_at, ref_sha)) AS b, arg_max(ref_sha, (seen_at, ref_sha)) AS h FROM e1 GROUP BY ALL",
    "revised": "SELECT DISTINCT e1.repo, e1.area, 'base' AS side, e1.repo || ' ' || s AS src, e1.repo || ' ' || t AS dst FROM e1 JOIN ends ON e1.repo = ends.repo AND e1.area = ends.area AND ref_sha = b UNION SELECT e1.repo, e1.area, 'head', e1.repo || ' ' || s, e1.repo || ' ' || t FROM e1 JOIN ends ON e1.repo = ends.repo AND e1.area = ends.area AND ref_sha = h",
    "edges": "SELECT DISTINCT src, dst FROM revised WHERE dst IS NOT NULL AND src <> dst",
    "base": "SELECT DISTINCT src, dst FROM revised WHERE dst IS NOT NULL AND src <> dst AND side = 'base'",
    "head": "SELECT DISTINCT src, dst FROM revised WHERE dst IS NOT NULL AND src <> dst AND side = 'head'",
    "defs": f"SELECT DISTINCT def_no, repo || ' ' || n AS node, repo || ' ' || {f_('n')} AS file, {s_('n')} AS sym, {l_('n')} AS leaf, start_line AS start, end_line AS end_, deleted_at IS NULL AS alive FROM (SELECT *, {n_('node')} AS n FROM graph_defs) WHERE n IS NOT NULL",
    "listings": f"SELECT DISTINCT ON (entry_no) entry_no, repo, repo || ' ' || e AS endpoint, split_part(e, ' ', 1) AS kind, repo || ' ' || {n_('handler')} AS handler, line_no AS line, aliases, implicit, first_seen, deleted_at FROM (SELECT *, {e_('endpoint')} AS e FROM inventory) WHERE e IS NOT NULL",
    "entries": "SELECT entry_no, endpoint, kind, handler, line FROM listings WHERE deleted_at IS NULL QUALIFY row_number() OVER (PARTITION BY endpoint ORDER BY first_seen, entry_no) = 1",
    "latest": "SELECT * FROM flow_maps QUALIFY row_number() OVER (PARTITION BY repo, area ORDER BY made_at DESC, map_no DESC) = 1",
    "mflows": "SELECT map_no, repo, area, agree_threshold, unnest(flows) AS flow, generate_subscripts(flows, 1) - 1 AS flow_pos FROM latest",
    "msteps0": "SELECT map_no, repo, area, agree_threshold, flow_pos, flow.id AS flow_id, unnest(flow.steps) AS s, generate_subscripts(flow.steps, 1) - 1 AS step_pos FROM mflows",
    "msteps": "SELECT map_no, repo, area, agree_threshold, flow_pos, flow_id, step_pos, s.id AS step_id, concat_ws(' ', repo, concat_ws('/', flow_id, s.id)) AS step, s.step_name, s.alt_names, s.actor, s.endpoints, s.ui, s.code_path, s.writes, s.evidence, s.runs FROM msteps0 WHERE s IS NOT NULL",
    "mends0": "SELECT repo, flow_id, step, map_no, flow_pos, step_pos, unnest(endpoints) AS v FROM msteps",
    "mends": f"SELECT DISTINCT repo, flow_id, step, map_no, flow_pos, step_pos, repo || ' ' || {e_('v')} AS endpoint FROM mends0 WHERE {e_('v')} IS NOT NULL",
    "anchors0": "SELECT repo, flow_id, step, unnest(code_path) AS v FROM msteps",
    "anchors": f"SELECT DISTINCT step, flow_id, repo || ' ' || n AS node, repo || ' ' || {f_('n')} AS file, {l_('n')} AS leaf FROM (SELECT *, {n_('v')} AS n FROM anchors0) WHERE n IS NOT NULL",
    "flow_of": "SELECT endpoint, arg_max(flow_id, (map_no, flow_pos, step_pos, flow_id)) AS flow FROM mends GROUP BY endpoint",
    "runs0": "SELECT DISTINCT ON (pass_no) * FROM map_runs",
    "rflows": "SELECT pass_no, repo, area, run_id, written_at, unnest(flows) AS flow, generate_subscripts(flows, 1) - 1 AS flow_pos FROM runs0",
    "rsteps": "SELECT pass_no, repo, area, run_id, written_at, flow_pos, flow.id AS flow_id, unnest(flow.steps) AS s, generate_subscripts(flow.steps, 1) - 1 AS step_pos FROM rflows",
    "places0": "SELECT *, unnest(s.endpoints) AS v FROM rsteps",
    "placements": f"SELECT repo || ' ' || area AS scope, endpoint, run_id, arg_min(flow_id, (pass_no, flow_pos, step_pos)) AS flow_id, arg_min(s.step_no, (pass_no, flow_pos, step_pos)) AS step_no, min((pass_no, flow_pos, step_pos)) AS pos FROM (SELECT *, repo || ' ' || {e_('v')} AS endpoint FROM places0 WHERE {e_('v')} IS NOT NULL) GROUP BY repo, area, endpoint, run_id",
    "lines": f"SELECT entry_no, {f_('handler')} AS file, {l_('handler')} AS leaf, line FROM listings WHERE handler IS NOT NULL AND line IS NOT NULL",
}
NAMED = {k: re.compile(rf"\b{k}\b(?!\s*\.?\()") for k in SQL}


def sql(body: str, recursive: str = "", **more: str) -> str:
    """A statement with the views it names, directly or through others, in front; more views by keyword, recursive ones as text."""
    order, views = list(SQL), dict(SQL)

    def needs(text: str) -> set[str]:
        return {k for k in order if NAMED[k].search(text)}

    todo, used = needs(body + " ".join(more.values()) + recursive), set()
    while todo:
        k = todo.pop()
        used.add(k)
        todo |= needs(views[k]) - used - {k}
    parts = [f"{k} AS MATERIALIZED ({views[k]})" for k in order if k in used] + [f"{k} AS ({v})" for k, v in more.items()]
    if recursive:
        parts.append(recursive)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n ".join(parts) + "\n" + body if parts else body
