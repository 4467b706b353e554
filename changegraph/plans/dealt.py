"""Queries p1 and p3: nested records as tables, references to what isn't there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegraph.functions import paths, tidy
from changegraph.operators.nested import NodeType, link, node_table, rejected
from changegraph.operators.orphans import orphan_report, orphans
from changegraph.session import Stash
from changegraph.sources.tables import load, load_steps, once

FLOW_MAP = [
    NodeType("flow", ("*",), name=("id",), holds="object"),
    NodeType("step", ("*", "steps", "*"), name=("id",), holds="object"),
    NodeType("endpoint", ("*", "steps", "*", "endpoints", "*"), holds="scalar"),
]
#: The record may stand under a key `facts`; flows and steps in lists or filed under their keys; entry points alone, in lists, or as objects.
FACTS = [
    t
    for root in ((), ("facts",))
    for t in (
        NodeType("flow", (*root, "map", "*"), name=("id",), holds="object"),
        NodeType("step", (*root, "map", "*", "steps", "*"), name=("key",), holds="object"),
        NodeType("endpoint", (*root, "map", "*", "steps", "*", "endpoints"), holds="scalar"),
        NodeType("endpoint", (*root, "map", "*", "steps", "*", "endpoints", "*"), value=("endpoint",)),
    )
]
FLOW_MAP_FLOWS = "map_no bigint, flows array<struct<id: string, steps: array<struct<id: string, endpoints: array<string>>>>>"


def nested_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Labelled nodes of both tables: src, rec_no, record_hash, node_type, pre, post, depth, name, value."""
    maps = node_table(load(spark, d, "flow_maps", FLOW_MAP_FLOWS).withColumnRenamed("map_no", "rec_no"), ["rec_no"], "flows", FLOW_MAP)
    facts = node_table(load(spark, d, "change_facts", "change_no bigint, facts string").withColumnRenamed("change_no", "rec_no"), ["rec_no"], "facts", FACTS)
    return maps.select(F.lit("flow_maps").alias("src"), "*").unionByName(facts.select(F.lit("change_facts").alias("src"), "*"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = link(nested_nodes(spark, d), ["src", "rec_no"], ["flow", "step", "endpoint"])
    return rows.select("src", "rec_no", F.col("flow_name").alias("flow_id"), F.col("step_name").alias("step_id"), F.coalesce("endpoint_value", F.lit("")).alias("endpoint")).distinct()


def p1_steps(spark: SparkSession, d: str) -> DataFrame:
    """The table of steps under their flows, with the interval label of each step."""
    rows = link(nested_nodes(spark, d), ["src", "rec_no"], ["flow", "step"])
    return rows.filter("step_pre is not null").select("src", "rec_no", F.col("flow_name").alias("flow_id"), F.col("step_name").alias("step_id"), "flow_pre", "step_pre").distinct()


def p1_rejected(spark: SparkSession, d: str) -> DataFrame:
    """The changes whose facts give no nodes, and why."""
    return rejected(load(spark, d, "change_facts", "change_no bigint, facts string"), ["change_no"], "facts").distinct()


def references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Tidied references of either kind: src_field, owner_no, repo, ref_value, at."""

    def cites(field: str, values) -> DataFrame:
        steps = load_steps(spark, d, field)
        return steps.select(F.lit(f"map_runs.{field}").alias("src_field"), F.col("step_no").alias("owner_no"), "repo", F.explode(values(field)).alias("ref_value"), F.col("written_at").alias("at"))

    entries = load(spark, d, "inventory", "entry_no bigint, repo string, handler string, first_seen timestamp_ntz")
    handlers = entries.select(F.lit("inventory.handler").alias("src_field"), F.col("entry_no").alias("owner_no"), "repo", tidy.node("handler").alias("ref_value"), F.col("first_seen").alias("at"))
    return cites("endpoints", tidy.entries), cites("code_path", tidy.nodes).unionByName(handlers)


def targets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What they refer to: repo, ref_value, live_from, live_to."""
    entries = load(spark, d, "inventory", "repo string, endpoint string, aliases array<string>, first_seen timestamp_ntz, deleted_at timestamp_ntz")
    names = F.concat(F.array("endpoint"), F.coalesce("aliases", F.array().cast("array<string>")))
    listed = entries.select("repo", F.explode(tidy.entries(names)).alias("ref_value"), F.col("first_seen").alias("live_from"), F.col("deleted_at").alias("live_to"))
    defs = load(spark, d, "graph_defs", "repo string, node string, first_seen timestamp_ntz, deleted_at timestamp_ntz")
    return listed, defs.select("repo", tidy.node("node").alias("ref_value"), F.col("first_seen").alias("live_from"), F.col("deleted_at").alias("live_to"))


def all_orphans(spark: SparkSession, d: str) -> DataFrame:
    found = [orphans(r, t, ["repo", "ref_value"]) for r, t in zip(references(spark, d), targets(spark, d))]
    return reduce(DataFrame.unionByName, found).dropDuplicates(["src_field", "owner_no", "ref_value", "kind"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return all_orphans(spark, d).select("src_field", "owner_no", "ref_value", "kind")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per referring field, month of the reference and kind."""
    report = orphan_report(all_orphans(spark, d), ["src_field"])
    return report.withColumn("period_start", F.date_format("period_start", "yyyy-MM-dd"))


def handler_keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Calls as references by repo, file and symbol, any of which may be unknown: an unresolved call has neither file nor symbol, and of
    a call out of a class only the file counts. What they refer to are the definitions that still stand."""
    calls = once(load(spark, d, "graph_edges", "edge_no bigint, repo string, src string, dst string, seen_at timestamp_ntz"), "edge_no", "repo", "src", "dst", "seen_at")
    symbol = F.when(~paths.symbol_of("s").contains("."), paths.symbol_of("t"))
    refs = calls.select("edge_no", "repo", "seen_at", tidy.node("src").alias("s"), tidy.node("dst").alias("t")).select(F.lit("graph_edges.dst").alias("src_field"), F.col("edge_no").alias("owner_no"), "repo", paths.file_of("t").alias("file"), symbol.alias("symbol"), F.col("seen_at").alias("at"))
    defs = load(spark, d, "graph_defs", "repo string, node string, first_seen timestamp_ntz, deleted_at timestamp_ntz").withColumn("n", tidy.node("node")).filter("n is not null")
    return refs, defs.select("repo", paths.file_of("n").alias("file"), paths.symbol_of("n").alias("symbol"), F.col("first_seen").alias("live_from"), F.col("deleted_at").alias("live_to"))


def _masked(spark: SparkSession, d: str, match: str) -> DataFrame:
    stash = Stash(spark)
    refs, defs = (stash.put(x) for x in handler_keys(spark, d))
    found = orphans(refs, defs, ["repo", "file", "symbol"], match=match)
    return found.groupBy(F.col("file").isNull().alias("no_file"), F.col("symbol").isNull().alias("no_symbol"), "kind").agg(F.count(F.lit(1)).alias("orphans"))


def p3_partial(spark: SparkSession, d: str) -> DataFrame:
    """Orphan calls under match partial, by what of their key is unknown: the known columns must be found together."""
    return _masked(spark, d, "partial")


def p3_full(spark: SparkSession, d: str) -> DataFrame:
    """Orphan calls under match full, by what of their key is unknown: keys must be known as a whole or not at all."""
    return _masked(spark, d, "full")


QUERIES = {f.__name__: f for f in (p1_found, p1_steps, p1_rejected, p3_found, p3_report, p3_partial, p3_full)}

#: Entry points and node ids as their tidied forms, for the oracle.
TIDY_ENTRY = "nullif(upper(split_part(regexp_replace(trim({0}), '\\s+', ' ', 'g'), ' ', 1)) || substr(regexp_replace(trim({0}), '\\s+', ' ', 'g'), length(split_part(regexp_replace(trim({0}), '\\s+', ' ', 'g'), ' ', 1)) + 1), '')"
TIDY_NODE = "nullif(regexp_replace(replace(trim({0}), '\\', '/'), '^\\./', ''), '')"
STEPS_SQL = """runs AS (SELECT DISTINCT ON (pass_no) * FROM map_runs),
 fl AS (SELECT pass_no, repo, area, run_id, written_at, unnest(flows) AS flow FROM runs),
 st AS (SELECT pass_no, repo, area, run_id, written_at, flow.id AS flow_id, unnest(flow.steps) AS s FROM fl)"""

P1_SQL = """
WITH j0 AS (SELECT change_no, TRY_CAST(facts AS JSON) AS j FROM change_facts),
 j1 AS (SELECT change_no, CASE WHEN json_type(j) = 'VARCHAR' THEN TRY_CAST(j ->> '$' AS JSON) ELSE j END AS j FROM j0),
 j2 AS (SELECT change_no, coalesce(j -> 'facts', j) -> 'map' AS m FROM j1 WHERE j IS NOT NULL),
 jf AS (SELECT change_no, e.key AS k, e.value AS f FROM j2, json_each(m) e WHERE e.type = 'OBJECT'),
 js AS (SELECT change_no, coalesce(f ->> 'id', k) AS flow_id, e.key AS k, e.value AS s FROM jf, json_each(f -> 'steps') e WHERE e.type = 'OBJECT'),
 jn AS (SELECT change_no, flow_id, coalesce(s ->> 'key', k) AS step_id, s, row_number() OVER () AS n FROM js),
 je AS (SELECT n, CASE WHEN e.type = 'OBJECT' THEN e.value ->> 'endpoint' ELSE e.atom ->> '$' END AS endpoint FROM jn, json_each(s -> 'endpoints') e WHERE e.type <> 'NULL'),
 mf AS (SELECT map_no, unnest(flows) AS f FROM flow_maps),
 ms AS (SELECT map_no, f.id AS flow_id, unnest(f.steps) AS s FROM mf)
SELECT DISTINCT 'change_facts' AS src, change_no AS rec_no, flow_id, step_id, coalesce(endpoint, '') AS endpoint FROM jn LEFT JOIN je USING (n)
UNION
SELECT 'flow_maps', map_no, flow_id, s.id, unnest(CASE WHEN len(list_filter(s.endpoints, lambda x: x IS NOT NULL)) > 0 THEN list_filter(s.endpoints, lambda x: x IS NOT NULL) ELSE [''] END) FROM ms WHERE s IS NOT NULL
"""
#: Pre-order numbers: of JSON the place in DuckDB's own walk of the tree; of a map's fields the sizes of what stands before.
P1_STEPS_SQL = """
WITH j0 AS (SELECT DISTINCT change_no, facts FROM change_facts),
 j1 AS (SELECT change_no, TRY_CAST(facts AS JSON) AS j FROM j0),
 j2 AS (SELECT change_no, CASE WHEN json_type(j) = 'VARCHAR' THEN TRY_CAST(j ->> '$' AS JSON) ELSE j END AS j FROM j1),
 tr AS (SELECT change_no, row_number() OVER (PARTITION BY change_no, md5(j::VARCHAR) ORDER BY t.rowid) - 1 AS pre, md5(j::VARCHAR) AS h, t.id AS id, t.parent AS parent, t.key AS key, t.value AS v, t.type AS type FROM (SELECT DISTINCT change_no, j FROM j2 WHERE j IS NOT NULL), json_tree(j) t),
 jsteps AS (SELECT s.change_no, coalesce(f.v ->> 'id', f.key) AS flow_id, coalesce(s.v ->> 'key', s.key) AS step_id, f.pre AS flow_pre, s.pre AS step_pre
  FROM tr s JOIN tr l ON l.change_no = s.change_no AND l.h = s.h AND l.id = s.parent AND l.key = 'steps' JOIN tr f ON f.change_no = s.change_no AND f.h = s.h AND f.id = l.parent
  JOIN tr m ON m.change_no = s.change_no AND m.h = s.h AND m.id = f.parent AND m.key = 'map' JOIN tr r ON r.change_no = s.change_no AND r.h = s.h AND r.id = m.parent AND (r.parent IS NULL OR r.key = 'facts')
  WHERE s.type = 'OBJECT' AND f.type = 'OBJECT'),
 fm AS (SELECT DISTINCT map_no, flows FROM flow_maps),
 ff AS (SELECT map_no, flows, unnest(flows) AS f, generate_subscripts(flows, 1) AS fi FROM fm),
 fp AS (SELECT map_no, f, 1 + coalesce(list_sum(list_transform(flows[1:fi - 1], lambda y: CASE WHEN y IS NULL THEN 1 ELSE 3 + coalesce(list_sum(list_transform(y.steps, lambda z: CASE WHEN z IS NULL THEN 1 ELSE 3 + coalesce(len(z.endpoints), 0) END)), 0) END)), 0)::BIGINT AS flow_pre FROM ff WHERE f IS NOT NULL),
 fs AS (SELECT map_no, f, flow_pre, unnest(f.steps) AS s, generate_subscripts(f.steps, 1) AS si FROM fp),
 msteps AS (SELECT map_no, f.id AS flow_id, s.id AS step_id, flow_pre, (flow_pre + 3 + coalesce(list_sum(list_transform(f.steps[1:si - 1], lambda z: CASE WHEN z IS NULL THEN 1 ELSE 3 + coalesce(len(z.endpoints), 0) END)), 0))::BIGINT AS step_pre FROM fs WHERE s IS NOT NULL)
SELECT DISTINCT 'change_facts' AS src, change_no AS rec_no, flow_id, step_id, flow_pre, step_pre FROM jsteps
UNION SELECT 'flow_maps', map_no, flow_id, step_id, flow_pre, step_pre FROM msteps
"""
ORPHANS_SQL = f"""
WITH {STEPS_SQL},
 refs AS (SELECT 'map_runs.endpoints' AS src_field, s.step_no AS owner_no, repo, unnest(s.endpoints) AS v, written_at AS at_ FROM st
  UNION ALL SELECT 'map_runs.code_path', s.step_no, repo, unnest(s.code_path), written_at FROM st
  UNION ALL SELECT 'inventory.handler', entry_no, repo, handler, first_seen FROM inventory),
 tidy AS (SELECT DISTINCT src_field, owner_no, repo, at_, CASE WHEN src_field = 'map_runs.endpoints' THEN {TIDY_ENTRY.format("v")} ELSE {TIDY_NODE.format("v")} END AS ref_value FROM refs),
 names AS (SELECT repo, unnest(list_append(coalesce(aliases, []), endpoint)) AS v, first_seen, deleted_at FROM inventory),
 targets AS (SELECT 'e' AS t, repo, {TIDY_ENTRY.format("v")} AS key, first_seen, deleted_at FROM names
  UNION SELECT 'n', repo, {TIDY_NODE.format("node")}, first_seen, deleted_at FROM graph_defs),
 found AS (SELECT DISTINCT src_field, owner_no, ref_value, at_,
   CASE WHEN NOT EXISTS (SELECT 1 FROM targets t WHERE t.t = CASE WHEN src_field = 'map_runs.endpoints' THEN 'e' ELSE 'n' END AND t.repo = r.repo AND t.key = r.ref_value) THEN 'missing'
    WHEN EXISTS (SELECT 1 FROM targets t WHERE t.t = CASE WHEN src_field = 'map_runs.endpoints' THEN 'e' ELSE 'n' END AND t.repo = r.repo AND t.key = r.ref_value AND t.first_seen <= r.at_) THEN 'deleted'
    ELSE 'late' END AS kind
  FROM tidy r WHERE ref_value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM targets t WHERE t.t = CASE WHEN src_field = 'map_runs.endpoints' THEN 'e' ELSE 'n' END AND t.repo = r.repo AND t.key = r.ref_value AND t.first_seen <= r.at_ AND (t.deleted_at IS NULL OR t.deleted_at > r.at_)))
"""
MASKED_SQL = f"""
WITH e AS (SELECT DISTINCT ON (edge_no) edge_no, repo, seen_at AS at_, {TIDY_NODE.format("src")} AS s, {TIDY_NODE.format("dst")} AS t FROM graph_edges),
 refs AS (SELECT edge_no, repo, at_, regexp_extract(t, '^(.*):[^:]*$', 1) AS file, t, s FROM e),
 r AS (SELECT edge_no, repo, at_, file, CASE WHEN NOT contains(regexp_extract(s, '([^:]*)$', 1), '.') THEN regexp_extract(t, '([^:]*)$', 1) END AS symbol FROM refs),
 d AS (SELECT DISTINCT repo, regexp_extract(n, '^(.*):[^:]*$', 1) AS file, regexp_extract(n, '([^:]*)$', 1) AS symbol, first_seen, deleted_at FROM (SELECT *, {TIDY_NODE.format("node")} AS n FROM graph_defs) WHERE n IS NOT NULL),
 same AS (SELECT edge_no, bool_or(first_seen <= at_ AND (deleted_at IS NULL OR deleted_at > at_)) AS live, bool_or(first_seen <= at_) AS was FROM r JOIN d ON d.repo = r.repo AND (r.file IS NULL OR d.file = r.file) AND (r.symbol IS NULL OR d.symbol = r.symbol) GROUP BY edge_no),
 masked AS (SELECT r.file IS NULL AS no_file, r.symbol IS NULL AS no_symbol, live, was, same.edge_no IS NOT NULL AS there FROM r LEFT JOIN same USING (edge_no))
"""
ORACLES = {
    "p1_steps": P1_STEPS_SQL,
    "p1_rejected": "SELECT DISTINCT change_no, CASE WHEN facts IS NULL THEN 'null' WHEN trim(facts) = '' THEN 'blank' ELSE 'not complete JSON' END AS reason FROM change_facts WHERE facts IS NULL OR trim(facts) = '' OR TRY_CAST(facts AS JSON) IS NULL",
    "p3_partial": MASKED_SQL + "SELECT no_file, no_symbol, CASE WHEN NOT there THEN 'missing' WHEN was THEN 'deleted' ELSE 'late' END AS kind, count(*) AS orphans FROM masked WHERE NOT there OR NOT live GROUP BY ALL",
    "p3_full": MASKED_SQL + "SELECT no_file, no_symbol, CASE WHEN no_file OR no_symbol OR NOT there THEN 'missing' WHEN was THEN 'deleted' ELSE 'late' END AS kind, count(*) AS orphans FROM masked WHERE no_file OR no_symbol OR NOT there OR NOT live GROUP BY ALL",
    "p1_found": P1_SQL,
    "p3_found": ORPHANS_SQL + "SELECT DISTINCT src_field, owner_no, ref_value, kind FROM found",
    "p3_report": ORPHANS_SQL + "SELECT src_field, strftime(date_trunc('month', at_), '%Y-%m-%d') AS period_start, kind, count(*) AS orphans FROM found GROUP BY ALL",
}
