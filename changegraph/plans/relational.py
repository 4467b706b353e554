"""Joins, filters, sorts and windows of the reference's queries over the code-map tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changegraph.functions import paths, tidy
from changegraph.operators import ranges
from changegraph.plans import views as V
from changegraph.plans.graphs import CHANGED_SQL, changed_edges
from changegraph.sources.tables import load

sql, QUERIES, ORACLES = V.sql, {}, {}
BASE_TIME, HEAD_TIME = "2025-01-01 00:00:00", "2026-01-01 00:00:00"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return add


def changed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return changed_edges(spark, d).select(F.col("src").alias("node")).distinct()


CHANGED = f"(SELECT DISTINCT src AS node FROM {CHANGED_SQL})"


@query("SELECT entry_no, endpoint, handler, start, end_ AS \"end\" FROM entries JOIN (SELECT * FROM defs WHERE alive) d ON handler = node")
def equi_join(spark, d):
    live = V.defs(spark, d).filter("alive").select(F.col("node").alias("handler"), "start", "end")
    return V.entries(spark, d).select("entry_no", "endpoint", "handler").join(live, "handler").select("entry_no", "endpoint", "handler", "start", "end")


@query("SELECT endpoint, coalesce(flow, 'unplaced') AS flow FROM entries LEFT JOIN flow_of USING (endpoint)")
def left_join_unplaced(spark, d):
    return V.entries(spark, d).select("endpoint").join(V.flow_of(spark, d), "endpoint", "left").select("endpoint", F.coalesce("flow", F.lit("unplaced")).alias("flow"))


@query(f"SELECT DISTINCT c.node, step, a.node AS anchor FROM {CHANGED} c JOIN anchors a ON {V.f_('c.node')} = a.file AND {V.l_('c.node')} = a.leaf")
def anchor_join(spark, d):
    c = changed_nodes(spark, d).select("node", paths.file_of("node").alias("file"), paths.leaf_of("node").alias("leaf"))
    return c.join(V.anchors(spark, d).select("step", F.col("node").alias("anchor"), "file", "leaf"), ["file", "leaf"]).select("node", "step", "anchor").distinct()


@query("SELECT l.entry_no, l.line, coalesce(arg_max(node, (start, -def_no)), '<module>') AS node FROM lines l LEFT JOIN (SELECT * FROM defs WHERE alive AND start <= end_) f ON f.file = l.file AND l.line BETWEEN start AND end_ GROUP BY ALL")
def range_join_innermost(spark, d):
    live = V.defs(spark, d).filter("alive").select("file", "node", "start", "end", "def_no")
    got = ranges.innermost(V.changed_lines(spark, d).select("entry_no", "file", "line"), live, ["file"], ["entry_no"], "line", "def_no")
    return got.select("entry_no", "line", F.coalesce("node", F.lit("<module>")).alias("node"))


@query("SELECT l.entry_no, arg_max(def_no, (CASE WHEN start <= line THEN 1 ELSE 0 END, CASE WHEN start <= line THEN start ELSE -start END, -def_no)) AS def_no FROM lines l LEFT JOIN (SELECT * FROM defs WHERE alive AND start IS NOT NULL) f ON f.file = l.file AND f.leaf = l.leaf GROUP BY l.entry_no")
def asof_nearest_before(spark, d):
    live = V.defs(spark, d).filter("alive").select("file", "leaf", "start", "def_no")
    got = ranges.nearest(V.changed_lines(spark, d), live, ["file", "leaf"], ["entry_no"], "line", "start", "def_no")
    return got.select("entry_no", "def_no")


def live_at(spark, d, at):
    return V.listings(spark, d).filter((F.col("first_seen") <= F.lit(at).cast("timestamp_ntz")) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > F.lit(at).cast("timestamp_ntz")))).groupBy("endpoint").agg(F.min("handler").alias("handler"))


LIVE = "(SELECT endpoint, min(handler) AS handler FROM listings WHERE first_seen <= TIMESTAMP '{0}' AND (deleted_at IS NULL OR deleted_at > TIMESTAMP '{0}') GROUP BY endpoint)"
LB, LH = LIVE.format(BASE_TIME), LIVE.format(HEAD_TIME)


@query(f"SELECT endpoint, CASE WHEN b.endpoint IS NULL THEN 'added' WHEN h.endpoint IS NULL THEN 'removed' WHEN b.handler IS DISTINCT FROM h.handler THEN 'moved' ELSE 'both' END AS status FROM {LB} b FULL JOIN {LH} h USING (endpoint)")
def full_outer_status(spark, d):
    b = live_at(spark, d, BASE_TIME).select("endpoint", F.col("handler").alias("hb"), F.lit(True).alias("in_b"))
    h = live_at(spark, d, HEAD_TIME).select("endpoint", F.col("handler").alias("hh"), F.lit(True).alias("in_h"))
    status = F.when(F.col("in_b").isNull(), "added").when(F.col("in_h").isNull(), "removed").when(~F.col("hb").eqNullSafe(F.col("hh")), "moved").otherwise("both")
    return b.join(h, "endpoint", "full_outer").select("endpoint", status.alias("status"))


@query(f"SELECT node FROM {CHANGED} WHERE node IN (SELECT node FROM defs)")
def semi_join(spark, d):
    return changed_nodes(spark, d).join(V.defs(spark, d).select("node"), "node", "left_semi")


@query("SELECT DISTINCT src AS node FROM head WHERE src NOT IN (SELECT src FROM base)")
def anti_join(spark, d):
    return V.edges(spark, d, "head").select(F.col("src").alias("node")).distinct().join(V.edges(spark, d, "base").select(F.col("src").alias("node")), "node", "left_anti")


@query(f"SELECT dst AS node, src AS caller, src IN (SELECT node FROM {CHANGED}) AS edited FROM edges WHERE dst IN (SELECT node FROM {CHANGED}) AND NOT starts_with(src, dst || '.')")
def flag_join(spark, d):
    c = changed_nodes(spark, d)
    e = V.edges(spark, d).join(c.withColumnRenamed("node", "dst"), "dst", "left_semi").filter(~F.expr("startswith(src, concat(dst, '.'))"))
    return e.join(c.select(F.col("node").alias("src"), F.lit(True).alias("hit")), "src", "left").select(F.col("dst").alias("node"), F.col("src").alias("caller"), F.col("hit").isNotNull().alias("edited"))


@query("SELECT a.class_node, b.node AS member FROM (SELECT DISTINCT file || ':' || split_part(sym, '.', 1) AS class_node, file, split_part(sym, '.', 1) AS top FROM defs WHERE alive AND contains(sym, '.')) a JOIN (SELECT DISTINCT node, file, sym FROM defs WHERE alive) b ON a.file = b.file AND starts_with(b.sym, a.top || '.')")
def prefix_join(spark, d):
    """Members of each class: definitions that have the class's name and a dot in front. Equal on file and first name, so no pair outside a class is made."""
    live = V.defs(spark, d).filter("alive").select("node", "file", "sym").distinct().withColumn("top", F.substring_index("sym", ".", 1)).filter("sym <> top")
    whole = live.select("file", "top").distinct().select("file", "top", F.concat_ws(":", "file", "top").alias("class_node"))
    return live.join(whole, ["file", "top"]).select("class_node", F.col("node").alias("member"))


@query("SELECT node FROM (SELECT DISTINCT node, file, sym FROM defs WHERE alive) a WHERE NOT EXISTS (SELECT 1 FROM defs b WHERE b.alive AND b.file = a.file AND starts_with(b.sym, a.sym || '.'))")
def prefix_anti(spark, d):
    """Definitions without the ones that hold others."""
    live = V.defs(spark, d).filter("alive").select("node", "file", "sym").distinct()
    holders = live.filter(F.instr("sym", ".") > 0).select("file", F.explode(F.expr("transform(sequence(1, size(split(sym, '[.]')) - 1), k -> substring_index(sym, '.', k))")).alias("sym"))
    return live.join(holders.distinct(), ["file", "sym"], "left_anti").select("node")


@query(
    f"SELECT entry_no, arg_min(d.node, (p, d.node)) AS resolved, count(*) AS candidates FROM (SELECT entry_no, d.node, CASE WHEN d.file = l.file THEN 1 WHEN array_to_string(string_split(d.file, '/')[1:2], '/') = array_to_string(string_split(l.file, '/')[1:2], '/') THEN 2 ELSE 3 END AS p FROM lines l JOIN (SELECT DISTINCT node, file, leaf FROM defs WHERE alive) d ON d.leaf = l.leaf AND split_part(d.file, ' ', 1) = split_part(l.file, ' ', 1)) d GROUP BY entry_no"
)
def priority_resolve(spark, d):
    """The definition a handler's last name resolves to: in its file, else its directory, else its repository."""
    live = V.defs(spark, d).filter("alive").select("node", F.col("file").alias("dfile"), "leaf").distinct()
    lines = V.changed_lines(spark, d)
    repo = lambda c: F.substring_index(c, " ", 1)
    met = lines.join(live, (lines["leaf"] == live["leaf"]) & (repo(lines["file"]) == repo(live["dfile"])))
    p = F.when(F.col("dfile") == F.col("file"), 1).when(paths.area_of("dfile") == paths.area_of("file"), 2).otherwise(3)
    return met.groupBy("entry_no").agg(F.min_by("node", F.struct(p, "node")).alias("resolved"), F.count(F.lit(1)).alias("candidates"))


@query("SELECT repo, leaf, count(*) AS candidates FROM (SELECT DISTINCT node, split_part(node, ' ', 1) AS repo, leaf FROM defs WHERE alive) GROUP BY ALL HAVING count(*) BETWEEN 2 AND 6")
def ambiguity_cap(spark, d):
    """Names that several definitions bear, but no more than six."""
    live = V.defs(spark, d).filter("alive").select("node", F.substring_index("node", " ", 1).alias("repo"), "leaf").distinct()
    return live.groupBy("repo", "leaf").agg(F.count(F.lit(1)).alias("candidates")).filter("candidates between 2 and 6")


@query(f"SELECT entry_no, CASE WHEN handler IN (SELECT node FROM defs WHERE alive) THEN 'node' WHEN {V.f_('handler')} IN (SELECT file FROM defs WHERE alive) THEN 'broken' ELSE 'not graphed' END AS class FROM entries")
def classify_handlers(spark, d):
    live = V.defs(spark, d).filter("alive")
    e = V.entries(spark, d).withColumn("file", paths.file_of("handler"))
    nodes = live.select(F.col("node").alias("handler"), F.lit(True).alias("is_node")).distinct()
    files = live.select("file", F.lit(True).alias("is_file")).distinct()
    return e.join(nodes, "handler", "left").join(files, "file", "left").select("entry_no", F.when(F.col("is_node"), "node").when(F.col("is_file"), "broken").otherwise("not graphed").alias("class"))


@query("SELECT src, dst FROM edges WHERE src IN (SELECT node FROM defs) AND dst IN (SELECT node FROM defs)")
def index_edges(spark, d):
    """Calls both ends of which are defined."""
    n = V.defs(spark, d).select("node").distinct()
    return V.edges(spark, d).join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


@query("SELECT 'unknown' AS what, endpoint FROM (SELECT DISTINCT endpoint FROM placements WHERE endpoint NOT IN (SELECT endpoint FROM listings)) UNION ALL SELECT 'unplaced', endpoint FROM entries WHERE endpoint NOT IN (SELECT endpoint FROM placements)")
def coverage_anti(spark, d):
    placed, listed = V.placements(spark, d).select("endpoint").distinct(), V.listings(spark, d).select("endpoint")
    unknown = placed.join(listed, "endpoint", "left_anti").select(F.lit("unknown").alias("what"), "endpoint")
    return unknown.unionByName(V.entries(spark, d).select("endpoint").join(placed, "endpoint", "left_anti").select(F.lit("unplaced").alias("what"), "endpoint"))


@query("SELECT DISTINCT step, node FROM anchors WHERE node IN (SELECT src FROM base UNION SELECT dst FROM base) AND node NOT IN (SELECT src FROM head UNION SELECT dst FROM head)")
def semi_then_anti(spark, d):
    """Anchors of steps that the base has and the head has lost."""
    side = lambda s: V.edges(spark, d, s).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return V.anchors(spark, d).select("step", "node").distinct().join(side("base"), "node", "left_semi").join(side("head"), "node", "left_anti").select("step", "node")


@query("SELECT entry_no, endpoint, handler FROM listings WHERE deleted_at IS NULL QUALIFY row_number() OVER (PARTITION BY endpoint ORDER BY first_seen, entry_no) = 1")
def entry_first_wins(spark, d):
    return V.entries(spark, d).select("entry_no", "endpoint", "handler")


@query(f"SELECT repo, name, count(DISTINCT entry_no) AS entries, count(DISTINCT handler) AS handlers FROM (SELECT repo, entry_no, handler, substr(endpoint, length(repo) + 2) AS name FROM listings UNION ALL SELECT repo, entry_no, handler, {V.e_('v')} FROM (SELECT repo, entry_no, handler, unnest(aliases) AS v FROM listings)) WHERE name IS NOT NULL GROUP BY repo, name HAVING count(DISTINCT entry_no) > 1")
def entry_conflicts(spark, d):
    """Names, as entry point or alias, that several rows of a repository's inventory claim, and how many handlers answer to them."""
    names = F.concat(F.array(F.expr("substring(endpoint, length(repo) + 2)")), "aliases")
    each = V.listings(spark, d).select("repo", "entry_no", "handler", F.explode(names).alias("name"))
    return each.groupBy("repo", "name").agg(F.countDistinct("entry_no").alias("entries"), F.countDistinct("handler").alias("handlers")).filter("entries > 1")


@query("SELECT DISTINCT flow_id, endpoint, coalesce(line, 1) AS line FROM mends LEFT JOIN entries USING (endpoint)")
def left_join_default(spark, d):
    m = V.map_endpoints(spark, d).select("flow_id", "endpoint").distinct()
    return m.join(V.entries(spark, d).select("endpoint", "line"), "endpoint", "left").select("flow_id", "endpoint", F.coalesce("line", F.lit(1)).alias("line"))


@query("SELECT endpoint, kind, row_number() OVER (PARTITION BY repo ORDER BY substr(endpoint, length(repo) + length(kind) + 3), endpoint) AS pos FROM (SELECT *, split_part(endpoint, ' ', 1) AS repo FROM entries)")
def sort_entries(spark, d):
    """Entry points of a repository in order of what follows their kind."""
    e = V.entries(spark, d).withColumn("repo", F.substring_index("endpoint", " ", 1))
    rest = F.expr("substr(endpoint, length(repo) + length(kind) + 3)")
    return ranges.numbered(e, ["repo"], [rest, "endpoint"], "pos").select("endpoint", "kind", "pos")


@query("SELECT kind, count(*) AS n FROM entries GROUP BY kind")
def kind_counts(spark, d):
    return V.entries(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_KIND = f"CASE WHEN regexp_matches(file, '{paths.TEST}') THEN 'test' WHEN regexp_matches(file, '{paths.CODE}') THEN 'code' WHEN starts_with(file, 'docs/map/') THEN 'generated' WHEN regexp_matches(file, '{paths.DOC}') THEN 'doc' ELSE 'outside' END"


@query(f"SELECT kind, count(*) AS files FROM (SELECT {_KIND} AS kind FROM (SELECT DISTINCT trim(file_path) AS file FROM documents WHERE file_path IS NOT NULL UNION SELECT DISTINCT {V.f_(V.n_('node'))} FROM graph_defs WHERE node IS NOT NULL)) GROUP BY kind")
def file_kind_case(spark, d):
    docs = load(spark, d, "documents", "file_path string").select(F.trim("file_path").alias("file")).dropna()
    code = load(spark, d, "graph_defs", "node string").select(paths.file_of(tidy.node("node")).alias("file")).dropna()
    return docs.union(code).distinct().groupBy(paths.file_kind("file").alias("kind")).agg(F.count(F.lit(1)).alias("files"))


@query(f"SELECT step, len(list_filter(code_path, lambda x: x IS NOT NULL)) AS hops FROM msteps WHERE list_has_any(flatten(list_transform(coalesce(code_path, []), lambda x: string_split(x, '/'))), ['lib', 'shared'])")
def array_overlap_filter(spark, d):
    """Steps whose code path goes through a shared directory."""
    parts = F.flatten(F.transform("code_path", lambda x: F.split(x, "/")))
    m = V.map_steps(spark, d).filter(F.arrays_overlap(parts, F.array(F.lit("lib"), F.lit("shared"))))
    return m.select("step", F.size(F.array_compact("code_path")).alias("hops"))


@query("SELECT node, file, start, lead(start) OVER (PARTITION BY file ORDER BY start, def_no) - 1 AS until FROM defs WHERE alive AND start IS NOT NULL")
def lead_intervals(spark, d):
    """Definitions that end where the next of their file starts."""
    live = V.defs(spark, d).filter("alive and start is not null")
    return live.select("node", "file", "start", (F.lead("start").over(Window.partitionBy("file").orderBy("start", "def_no")) - 1).alias("until"))


@query("SELECT entry_no, last_value(line IGNORE NULLS) OVER (PARTITION BY split_part(endpoint, ' ', 1), kind ORDER BY entry_no ROWS UNBOUNDED PRECEDING) AS line FROM listings")
def forward_fill(spark, d):
    rows = V.listings(spark, d).select("repo", "kind", "entry_no", "line")
    return ranges.last_before(rows, ["repo", "kind"], "entry_no", "line", "filled").select("entry_no", F.col("filled").alias("line"))


@query("SELECT map_no, flow_pos, step_pos, CASE WHEN rn = 1 THEN step ELSE step || '-' || rn END AS key FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY map_no, flow_pos, step_pos) AS rn FROM msteps)")
def dedupe_keys(spark, d):
    m = ranges.numbered(V.map_steps(spark, d), ["step"], ["map_no", "flow_pos", "step_pos"])
    return m.select("map_no", "flow_pos", "step_pos", F.when(F.col("rn") == 1, F.col("step")).otherwise(F.concat_ws("-", "step", F.col("rn").cast("string"))).alias("key"))


@query("SELECT flow_id, array_to_string(list_slice(list_sort(list(DISTINCT endpoint)), 1, 3), ', ') || CASE WHEN count(DISTINCT endpoint) > 3 THEN ' +' || (count(DISTINCT endpoint) - 3) || ' more' ELSE '' END AS shown FROM mends GROUP BY flow_id")
def topk_more(spark, d):
    """Three entry points of each flow and how many more there are; the first three by rank, so that no flow's entry points are collected."""
    m = V.map_endpoints(spark, d).select("flow_id", "endpoint").distinct()
    n = m.groupBy("flow_id").agg(F.count(F.lit(1)).alias("n"))
    first = ranges.numbered(m, ["flow_id"], ["endpoint"]).filter("rn <= 3").groupBy("flow_id").agg(F.array_join(F.array_sort(F.collect_list("endpoint")), ", ").alias("s"))
    return first.join(n, "flow_id").select("flow_id", F.concat("s", F.when(F.col("n") > 3, F.concat(F.lit(" +"), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise("")).alias("shown"))


@query("SELECT step, row_number() OVER (PARTITION BY repo, flow_id ORDER BY len(coalesce(endpoints, [])), step_id, map_no, flow_pos, step_pos) AS pos, map_no FROM msteps")
def order_steps(spark, d):
    m = V.map_steps(spark, d).withColumn("n", F.size(F.coalesce("endpoints", F.array().cast("array<string>"))))
    return ranges.numbered(m, ["repo", "flow_id"], ["n", F.asc_nulls_last("step_id"), "map_no", "flow_pos", "step_pos"], "pos").select("step", "pos", "map_no")


VOCABULARY = ("read-a-meter", "return-a-loan", "answer-a-ticket")


@query("SELECT flow_id, row_number() OVER (ORDER BY CASE flow_id WHEN 'read-a-meter' THEN 0 WHEN 'return-a-loan' THEN 1 WHEN 'answer-a-ticket' THEN 2 ELSE 9999 END, flow_id) AS pos FROM (SELECT DISTINCT flow_id FROM msteps WHERE flow_id IS NOT NULL)")
def custom_order(spark, d):
    """Flows in the vocabulary's order, then the rest by name. The flows are a bounded vocabulary, so one window may order them all."""
    flows = V.map_steps(spark, d).select("flow_id").dropna().distinct()
    place = F.coalesce(*[F.when(F.col("flow_id") == x, i) for i, x in enumerate(VOCABULARY)], F.lit(9999))
    return flows.select("flow_id", F.row_number().over(Window.orderBy(place, "flow_id")).alias("pos"))


@query("SELECT step, len(list_filter(string_split(lower(step_name), ' '), lambda x: contains(x, 'route'))) AS hits FROM msteps WHERE contains(lower(step_name), 'route')")
def search_steps(spark, d):
    m = V.map_steps(spark, d).filter(F.lower("step_name").contains("route"))
    return m.select("step", F.size(F.filter(F.split(F.lower("step_name"), " "), lambda x: x.contains("route"))).cast("bigint").alias("hits"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN translate(left(text, 59) || '…', '\"<>', '''‹›') ELSE translate(text, '\"<>', '''‹›') END AS label FROM documents WHERE text IS NOT NULL")
def label_truncate(spark, d):
    return load(spark, d, "documents", "doc_id bigint, text string").filter("text is not null").select("doc_id", paths.truncated("text").alias("label"))


@query("SELECT endpoint, '/' || array_to_string(list_transform(list_filter(string_split(p, '/'), lambda s: s <> '' AND NOT regexp_matches(s, '^\\(.*\\)$')), lambda s: regexp_replace(regexp_replace(s, '^\\[+(\\.\\.\\.)?([^\\]]+)\\]+$', '{\\2}'), '^:(.+)$', '{\\1}')), '/') AS route FROM (SELECT endpoint, regexp_extract(endpoint, '(/.*)$', 1) AS p FROM entries) WHERE p <> ''")
def path_normalise(spark, d):
    e = V.entries(spark, d).select("endpoint", F.regexp_extract("endpoint", r"(/.*)$", 1).alias("p")).filter("p <> ''")
    return e.select("endpoint", paths.normalised_route("p").alias("route"))


@query("SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '`(GET|POST|PUT|PATCH|DELETE|CLI|JOB|TOOL|ACTION) [^`]+`', 1)) AS kind FROM documents) GROUP BY ALL")
def regex_scan(spark, d):
    docs = load(spark, d, "documents", "doc_id bigint, text string")
    got = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"`(GET|POST|PUT|PATCH|DELETE|CLI|JOB|TOOL|ACTION) [^`]+`"), 1)).alias("kind"))
    return got.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT doc_id, endpoint FROM (SELECT doc_id, repo || ' ' || {V.e_('m')} AS endpoint FROM (SELECT doc_id, repo, unnest(regexp_extract_all(text, '`([^`\\n]+)`', 1)) AS m FROM documents) WHERE {V.e_('m')} IS NOT NULL) JOIN entries USING (endpoint)")
def regex_theta_join(spark, d):
    """Entry points that a text of their repository names in code marks: the marks are cut out once and joined on equal names, no pattern meets every text."""
    docs = load(spark, d, "documents", "doc_id bigint, repo string, text string")
    marks = docs.select("doc_id", "repo", F.explode(F.regexp_extract_all("text", F.lit(r"`([^`\n]+)`"), 1)).alias("m")).select("doc_id", F.concat_ws(" ", "repo", tidy.entry("m")).alias("endpoint"), tidy.entry("m").alias("e"), "repo")
    return marks.filter("e is not null and repo is not null").join(V.entries(spark, d).select("endpoint"), "endpoint").select("doc_id", "endpoint").distinct()


@query("SELECT doc_id, length(split_part(text, '```', 1)) - length(replace(split_part(text, '```', 1), chr(10), '')) + 1 AS line FROM documents WHERE contains(text, '```')")
def line_of_match(spark, d):
    docs = load(spark, d, "documents", "doc_id bigint, text string").filter(F.col("text").contains("```"))
    head = F.substring_index("text", "```", 1)
    return docs.select("doc_id", (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).alias("line"))


@query("SELECT doc_id, regexp_extract(text, '```([^`]*)```', 1) AS code FROM documents WHERE regexp_matches(text, '```[^`]*```')")
def html_extract(spark, d):
    """The first block that is embedded in a text between fences."""
    docs = load(spark, d, "documents", "doc_id bigint, text string").filter(F.col("text").rlike("```[^`]*```"))
    return docs.select("doc_id", F.regexp_extract("text", "```([^`]*)```", 1).alias("code"))


@query("SELECT file, count(DISTINCT doc_id) AS importers FROM (SELECT doc_id, regexp_extract(m, '^(.*):[^:]*$', 1) AS file FROM (SELECT doc_id, unnest(regexp_extract_all(text, '`([^`\\n]+:[^`\\n]+)`', 1)) AS m FROM documents)) WHERE file <> '' GROUP BY file")
def importers_count(spark, d):
    """In how many documents each file is named."""
    docs = load(spark, d, "documents", "doc_id bigint, text string")
    m = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"`([^`\n]+:[^`\n]+)`"), 1)).alias("m")).select("doc_id", paths.file_of("m").alias("file"))
    return m.filter("file <> ''").groupBy("file").agg(F.countDistinct("doc_id").alias("importers"))
