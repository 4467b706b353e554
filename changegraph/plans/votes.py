"""Consensus queries: votes of mapping passes, evidence, overlap and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changegraph.functions import paths, tidy
from changegraph.operators import consensus, graph, reconcile
from changegraph.plans import views as V
from changegraph.session import Stash
from changegraph.sources.tables import load

sql, QUERIES, ORACLES = V.sql, {}, {}


def query(oracle: str | None = None, recursive: str = "", **more: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle, recursive, **more)
        return f

    return add


#: How many must agree follows from the number of mappers of the area; votes come in the order of passes, flows and steps.
MAPPERS = "SELECT repo, area, count(DISTINCT run_id) AS runs, CAST(greatest(2, ceil(count(DISTINCT run_id) * 3 / 4)) AS INTEGER) AS need FROM runs0 GROUP BY repo, area"
COUNTS = "SELECT scope, endpoint, flow_id, count(*) AS v, min(pos) AS o FROM placements WHERE flow_id IS NOT NULL GROUP BY ALL"
TOP = "SELECT scope, endpoint, arg_min(flow_id, (-v, o, flow_id)) AS flow_id, max(v) AS votes, sum(v)::BIGINT AS voters FROM counts GROUP BY scope, endpoint"
STATUS = "SELECT scope, endpoint, flow_id, votes, voters, (SELECT count(*) FROM counts WHERE counts.endpoint = top.endpoint AND counts.scope = top.scope AND v = votes) > 1 AS tied, CASE WHEN votes >= need THEN 'agreed' WHEN votes >= 2 THEN 'contested' ELSE 'single-source' END AS status FROM top JOIN mappers ON scope = mappers.repo || ' ' || mappers.area"
VOTES = {"mappers": MAPPERS, "counts": COUNTS, "top": TOP, "status_of": STATUS}


def scoped_need(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "map_runs", "repo string, area string, run_id string")
    return reconcile.needs(m.select(F.concat_ws(" ", "repo", "area").alias("scope"), "run_id"))


def voted(spark: SparkSession, d: str) -> DataFrame:
    """scope, endpoint, flow_id, votes, voters, tied, status: before ties are broken."""
    p = V.placements(spark, d).filter("flow_id is not null")
    counts = p.groupBy("scope", "endpoint", "flow_id").agg(F.count(F.lit(1)).alias("v"), F.min("pos").alias("o"))
    top = counts.groupBy("scope", "endpoint").agg(F.min_by("flow_id", F.struct(-F.col("v"), F.col("o"), F.col("flow_id"))).alias("flow_id"), F.max("v").alias("votes"), F.sum("v").alias("voters"))
    ties = counts.join(top.select("scope", "endpoint", F.col("votes").alias("m")), ["scope", "endpoint"]).filter("v = m").groupBy("scope", "endpoint").agg((F.count(F.lit(1)) > 1).alias("tied"))
    met = top.join(ties, ["scope", "endpoint"]).join(scoped_need(spark, d), "scope")
    return met.select("scope", "endpoint", "flow_id", "votes", "voters", "tied", reconcile.status(F.col("votes"), F.col("need")).alias("status"))


def reconciled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The passes of every area made into one map."""
    r = V.runs(spark, d)
    ends = F.transform(tidy.entries("endpoints"), lambda e: F.concat_ws(" ", F.col("repo"), e))
    pos = F.struct("pass_no", "flow_pos", "step_pos")
    n = F.count(F.lit(1)).over(Window.partitionBy("pass_no", "flow_pos"))
    steps = Stash(spark).put(r.select(F.concat_ws(" ", "repo", "area").alias("scope"), "run_id", "flow_id", pos.alias("pos"), (F.col("step_pos") / F.greatest(n, F.lit(1))).alias("at"), "step_no", "id", "step_name", "actor", "ui", "code_path", "writes", ends.alias("endpoint_list")))
    files = V.entries(spark, d).filter("handler is not null").select("endpoint", paths.file_of("handler").alias("file"))
    return reconcile.reconcile(spark, steps, files)


#: Ties go to the flow that the agreed entry points of the handler's file are in most.
SETTLED = {
    **VOTES,
    "handled": "SELECT endpoint, regexp_extract(handler, '^(.*):[^:]*$', 1) AS file FROM entries WHERE handler IS NOT NULL",
    "affinity": "SELECT file, flow_id, count(*) AS n FROM status_of JOIN handled USING (endpoint) WHERE status = 'agreed' GROUP BY ALL",
    "tied_choices": "SELECT counts.endpoint, counts.flow_id, o, file, status_of.flow_id AS top_flow FROM counts JOIN status_of ON status_of.endpoint = counts.endpoint LEFT JOIN handled ON handled.endpoint = counts.endpoint WHERE tied AND v = votes",
    "broken": "SELECT endpoint, arg_min(flow_id, (-coalesce(n, 0), CASE WHEN flow_id = top_flow THEN 0 ELSE 1 END, o, flow_id)) AS flow_id FROM tied_choices LEFT JOIN affinity USING (file, flow_id) GROUP BY endpoint",
    "rf": "SELECT scope, endpoint, coalesce(broken.flow_id, status_of.flow_id) AS flow, votes, voters, tied, status FROM status_of LEFT JOIN broken USING (endpoint)",
}
#: The rest of the reconciliation: entry points that enough steps hold together, the step of each mapper that fits a group best, its hops.
STEPS = {
    "ct": f"SELECT DISTINCT repo || ' ' || area AS scope, run_id, flow_id, pass_no, flow_pos, step_pos, s.step_no AS step_no, repo || ' ' || {V.e_('v')} AS endpoint FROM places0 WHERE {V.e_('v')} IS NOT NULL",
    "prs": "SELECT x.endpoint AS a, y.endpoint AS b, count(DISTINCT x.step_no) AS n FROM ct x JOIN ct y ON x.step_no = y.step_no AND x.endpoint < y.endpoint GROUP BY ALL",
    "lks": "SELECT a, b FROM prs JOIN rf p ON p.endpoint = a JOIN rf q ON q.endpoint = b AND p.flow = q.flow AND p.scope = q.scope JOIN mappers m ON p.scope = m.repo || ' ' || m.area WHERE n >= need",
    "lk2": "SELECT a, b FROM lks UNION SELECT b, a FROM lks UNION SELECT endpoint, endpoint FROM rf",
    "cl(v, w)": "SELECT a, b FROM lk2 UNION SELECT cl.v, lk2.b FROM cl JOIN lk2 ON cl.w = lk2.a",
    "gr": "SELECT v AS endpoint, min(w) AS grp FROM cl GROUP BY v",
    "gs": "SELECT grp, count(*) AS k FROM gr GROUP BY grp",
    "hs": "SELECT step_no, count(DISTINCT endpoint) AS k FROM ct GROUP BY step_no",
    "ov": "SELECT grp, run_id, pass_no, flow_pos, step_pos, ct.step_no, count(*) AS o FROM gr JOIN ct USING (endpoint) GROUP BY ALL",
    "sc2": "SELECT grp, run_id, pass_no, flow_pos, step_pos, step_no, o / (gs.k + hs.k - o)::DOUBLE AS j FROM ov JOIN gs USING (grp) JOIN hs USING (step_no)",
    "bm": "SELECT * FROM sc2 QUALIFY row_number() OVER (PARTITION BY grp, run_id ORDER BY j DESC, pass_no, flow_pos, step_pos, step_no) = 1",
    "det": "SELECT s.step_no AS step_no, step_pos / greatest(1, count(*) OVER (PARTITION BY pass_no, flow_pos))::DOUBLE AS at_, s.id AS id, s.step_name AS step_name, s.actor AS actor, s.code_path AS code_path FROM rsteps",
    "mt": "SELECT bm.*, at_, id, step_name, actor, code_path FROM bm JOIN det USING (step_no)",
    "sm": "SELECT grp, min(scope) AS scope, min(flow) AS flow, array_to_string(list_sort(list(endpoint)), ', ') AS endpoints, bool_and(status = 'single-source') AS all_single, bool_and(status IN ('agreed', 'confirmed')) AS all_agreed FROM gr JOIN rf USING (endpoint) GROUP BY grp",
    "sn": "SELECT grp, count(*) AS matches, count(*) FILTER (j = 1) AS exact, arg_min(step_name, (-j, pass_no, flow_pos, step_pos)) AS step_name, array_to_string(list_sort(list(DISTINCT run_id)), ', ') AS runs, round(avg(at_), 6) AS position FROM mt GROUP BY grp",
    "ids": "SELECT grp, arg_min(id, (-n, o, id)) AS id FROM (SELECT grp, id, count(*) AS n, min((-j, pass_no, flow_pos, step_pos)) AS o FROM mt GROUP BY grp, id) GROUP BY grp",
    "acs": "SELECT grp, arg_min(actor, (-n, o, actor)) AS actor FROM (SELECT grp, actor, count(*) AS n, min((-j, pass_no, flow_pos, step_pos)) AS o FROM mt GROUP BY grp, actor) GROUP BY grp",
    "hp0": "SELECT grp, run_id, greatest(1, len(coalesce(code_path, []))) AS n, unnest(code_path) AS v, generate_subscripts(code_path, 1) AS i0 FROM mt",
    "hp1": f"SELECT grp, run_id, n, {V.n_('v')} AS hop, min(i0) AS i0 FROM hp0 WHERE {V.n_('v')} IS NOT NULL GROUP BY ALL",
    "hp2": "SELECT grp, hop, (row_number() OVER (PARTITION BY grp, run_id ORDER BY i0) - 1) / n::DOUBLE AS place FROM hp1",
    "hp3": "SELECT grp, hop, count(*) AS votes, round(avg(place), 9) AS place FROM hp2 GROUP BY grp, hop",
    "hp4": "SELECT grp, hop, place, votes >= 2 OR m.runs = 1 AS kept FROM hp3 JOIN sm USING (grp) JOIN mappers m ON scope = m.repo || ' ' || m.area",
    "hp": "SELECT grp, array_to_string(list(hop ORDER BY place, hop) FILTER (kept), ', ') AS hops, array_to_string(list_sort(list(hop) FILTER (NOT kept)), ', ') AS disputed, count(DISTINCT regexp_extract(hop, '^(.*):[^:]*$', 1)) FILTER (kept) AS files FROM hp4 GROUP BY grp",
    "rm": "SELECT sm.scope, sm.flow, sm.grp, id, step_name, actor, endpoints, coalesce(hops, '') AS hops, coalesce(disputed, '') AS disputed, coalesce(files, 0) AS files, exact, sn.runs AS runs, CASE WHEN all_single THEN 'single-source' WHEN exact >= need AND all_agreed THEN 'agreed' WHEN exact >= need OR matches >= 2 THEN 'contested' ELSE 'single-source' END AS evidence, position FROM sm JOIN sn USING (grp) LEFT JOIN ids USING (grp) LEFT JOIN acs USING (grp) LEFT JOIN hp USING (grp) JOIN mappers m ON sm.scope = m.repo || ' ' || m.area",
}


@query("SELECT * FROM rf", **SETTLED)
def reconcile_flows(spark, d):
    return reconciled(spark, d)[0]


@query("SELECT * FROM rm", recursive=", ".join(f"{k} AS ({v})" for k, v in {**SETTLED, **STEPS}.items()))
def reconcile_map(spark, d):
    """Steps of the reconciled maps, arrays joined."""
    flat = lambda c: F.array_join(c, ", ").alias(c)
    return reconciled(spark, d)[1].select("scope", "flow", "grp", "id", "step_name", "actor", flat("endpoints"), flat("hops"), flat("disputed"), "files", "exact", flat("runs"), "evidence", "position")


@query("SELECT endpoint, flow_id, votes, voters, tied, status FROM status_of", **VOTES)
def plurality_vote(spark, d):
    return voted(spark, d).drop("scope")


@query("SELECT DISTINCT n, CAST(greatest(2, ceil(n * 3 / 4)) AS INTEGER) AS need FROM (SELECT count(DISTINCT run_id) AS n FROM runs0 GROUP BY repo, area)")
def agree_threshold(spark, d):
    p = load(spark, d, "map_runs", "repo string, area string, run_id string")
    n = p.groupBy("repo", "area").agg(F.countDistinct("run_id").alias("n"))
    return n.select("n", consensus.threshold(F.col("n")).alias("need")).distinct()


@query("SELECT status, tied, count(*) AS endpoints FROM status_of GROUP BY ALL", **VOTES)
def tie_detect(spark, d):
    return voted(spark, d).groupBy("status", "tied").agg(F.count(F.lit(1)).alias("endpoints"))


@query("SELECT endpoint, run_id, flow_id, step_no FROM placements")
def first_placement(spark, d):
    return V.placements(spark, d).select("endpoint", "run_id", "flow_id", "step_no")


@query(
    "SELECT endpoint, arg_min(flow_id, (-coalesce(n, 0), CASE WHEN flow_id = top_flow THEN 0 ELSE 1 END, o, flow_id)) AS flow_id FROM tied_choices LEFT JOIN affinity USING (file, flow_id) GROUP BY endpoint",
    **VOTES,
    handled="SELECT endpoint, regexp_extract(handler, '^(.*):[^:]*$', 1) AS file FROM entries WHERE handler IS NOT NULL",
    affinity="SELECT file, flow_id, count(*) AS n FROM status_of JOIN handled USING (endpoint) WHERE status = 'agreed' GROUP BY ALL",
    tied_choices="SELECT counts.endpoint, counts.flow_id, o, file, status_of.flow_id AS top_flow FROM counts JOIN status_of ON status_of.endpoint = counts.endpoint LEFT JOIN handled ON handled.endpoint = counts.endpoint WHERE tied AND v = votes",
)
def affinity_tiebreak(spark, d):
    """Of tied flows the one that the agreed entry points of the handler's file are in most, else the one voted first."""
    files = V.entries(spark, d).filter("handler is not null").select("endpoint", paths.file_of("handler").alias("file"))
    got = reconcile.flows_of(V.placements(spark, d), scoped_need(spark, d), files)
    return got.filter("tied").select("endpoint", F.col("flow").alias("flow_id"))


@query("SELECT a, b, count(*) AS n FROM (SELECT x.endpoint AS a, y.endpoint AS b FROM placements x JOIN placements y ON x.step_no = y.step_no AND x.endpoint < y.endpoint) GROUP BY ALL")
def pair_counts(spark, d):
    """Entry points placed in one step together, and by how many steps of passes."""
    return consensus.together(V.placements(spark, d), "step_no", "endpoint")


@query(
    "SELECT v AS endpoint, min(w) AS grp FROM cc GROUP BY v",
    recursive="pc AS (SELECT x.endpoint AS a, y.endpoint AS b, count(*) AS n FROM placements x JOIN placements y ON x.step_no = y.step_no AND x.endpoint < y.endpoint GROUP BY ALL), top1 AS (SELECT endpoint, arg_min(flow_id, (-v, o, flow_id)) AS flow_id FROM (SELECT endpoint, flow_id, count(*) AS v, min(pos) AS o FROM placements WHERE flow_id IS NOT NULL GROUP BY ALL) GROUP BY endpoint), lk AS (SELECT a, b FROM pc JOIN top1 p ON p.endpoint = a JOIN top1 q ON q.endpoint = b WHERE n >= 2 AND p.flow_id = q.flow_id), l2 AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk UNION SELECT endpoint, endpoint FROM top1), cc(v, w) AS (SELECT a, b FROM l2 UNION SELECT cc.v, l2.b FROM cc JOIN l2 ON cc.w = l2.a)",
)
def consensus_steps(spark, d):
    """Entry points of one flow that at least two steps have together, directly or through others, make a step; the rest stand alone."""
    stash = Stash(spark)
    top = stash.put(voted(spark, d).select("endpoint", "flow_id"))
    pairs = consensus.together(V.placements(spark, d), "step_no", "endpoint").filter("n >= 2")
    of = lambda x: top.select(F.col("endpoint").alias(x), F.col("flow_id").alias(f"f{x}"))
    links = pairs.join(of("a"), "a").join(of("b"), "b").filter("fa = fb").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return graph.connected(spark, links, top.select(F.col("endpoint").alias("node"))).select(F.col("node").alias("endpoint"), F.col("component").alias("grp"))


@query("SELECT step, max(CASE WHEN list_position(['single-source', 'contested', 'agreed', 'tested', 'confirmed'], evidence) > 0 THEN list_position(['single-source', 'contested', 'agreed', 'tested', 'confirmed'], evidence) END) AS rung FROM msteps GROUP BY step")
def evidence_ladder(spark, d):
    return V.map_steps(spark, d).groupBy("step").agg(F.max(consensus.rung(F.col("evidence"))).alias("rung"))


@query("SELECT flow_id, " + ", ".join(f"count(*) FILTER (evidence = '{x}') AS {x.replace('-', '_')}" for x in consensus.LADDER) + ", count(*) FILTER (evidence IN ('agreed', 'tested', 'confirmed')) / count(*)::DOUBLE AS solid FROM msteps GROUP BY flow_id")
def evidence_pivot(spark, d):
    solid = F.count(F.when(F.col("evidence").isin("agreed", "tested", "confirmed"), 1)) / F.count(F.lit(1))
    return V.map_steps(spark, d).groupBy("flow_id").agg(*[F.count(F.when(F.col("evidence") == x, 1)).alias(x.replace("-", "_")) for x in consensus.LADDER], solid.alias("solid"))


def hops(spark: SparkSession, d: str) -> DataFrame:
    """repo, flow_id, id, run_id, hop, place: the distinct hops of each step's code path; the place counts distinct hops and divides by the raw length."""
    r = V.runs(spark, d).filter("flow_id is not null and id is not null")
    raw = F.size(F.coalesce("code_path", F.array().cast("array<string>")))
    ordered = r.select("repo", "flow_id", "id", "run_id", "step_no", F.greatest(F.lit(1), raw).alias("n"), F.posexplode(tidy.nodes("code_path")).alias("i", "hop"))
    return ordered.select("repo", "flow_id", "id", "run_id", "step_no", "hop", (F.col("i") / F.col("n")).alias("place"))


HOPS = {
    "hp0": "SELECT repo, flow_id, s.id AS id, run_id, s.step_no AS step_no, greatest(1, len(coalesce(s.code_path, []))) AS n, unnest(s.code_path) AS v, generate_subscripts(s.code_path, 1) AS i0 FROM rsteps WHERE flow_id IS NOT NULL AND s.id IS NOT NULL",
    "hp1": f"SELECT repo, flow_id, id, run_id, step_no, n, {V.n_('v')} AS hop, min(i0) AS i0 FROM hp0 WHERE {V.n_('v')} IS NOT NULL GROUP BY ALL",
    "hp": "SELECT repo, flow_id, id, run_id, step_no, hop, (row_number() OVER (PARTITION BY step_no ORDER BY i0) - 1) / n::DOUBLE AS place FROM hp1",
}


@query("SELECT repo, flow_id, id, hop, count(DISTINCT run_id) AS votes, round(avg(place), 6) AS place FROM hp GROUP BY ALL HAVING count(DISTINCT run_id) >= 2", **HOPS)
def hop_consensus(spark, d):
    """The hops that at least two mappers see in steps of the same name, with their mean place."""
    return hops(spark, d).groupBy("repo", "flow_id", "id", "hop").agg(F.countDistinct("run_id").alias("votes"), F.round(F.avg("place"), 6).alias("place")).filter("votes >= 2")


@query("SELECT step_no, hop, place FROM hp", **HOPS)
def relative_position(spark, d):
    return hops(spark, d).select("step_no", "hop", "place")


@query("SELECT repo, flow_id, id, arg_min(actor, (-n, o, actor)) AS actor FROM (SELECT repo, flow_id, s.id AS id, s.actor AS actor, count(*) AS n, min(s.step_no) AS o FROM rsteps WHERE s.actor IS NOT NULL GROUP BY ALL) GROUP BY ALL")
def mode_first_seen(spark, d):
    return consensus.mode_first(V.runs(spark, d).filter("actor is not null"), ["repo", "flow_id", "id"], "actor", "step_no")


@query("SELECT repo, flow_id, id, array_to_string(list_sort(list(DISTINCT w)), ', ') AS writes FROM (SELECT repo, flow_id, s.id AS id, unnest(s.writes) AS w FROM rsteps) WHERE w IS NOT NULL GROUP BY ALL")
def collect_sorted_set(spark, d):
    r = V.runs(spark, d).select("repo", "flow_id", "id", F.explode("writes").alias("w")).dropna(subset=["w"]).distinct()
    return r.groupBy("repo", "flow_id", "id").agg(F.array_join(F.array_sort(F.collect_list("w")), ", ").alias("writes"))


@query("SELECT step, count(DISTINCT node) AS hops, count(DISTINCT file) AS files FROM anchors GROUP BY step")
def busyness(spark, d):
    return V.anchors(spark, d).groupBy("step").agg(F.countDistinct("node").alias("hops"), F.countDistinct("file").alias("files"))


@query("SELECT step, count(DISTINCT node) AS hops FROM anchors GROUP BY step HAVING count(DISTINCT node) >= 8")
def busiest_steps(spark, d):
    return V.anchors(spark, d).groupBy("step").agg(F.countDistinct("node").alias("hops")).filter("hops >= 8")


@query("SELECT flow_id, arg_min(summary, (repo, area)) AS summary FROM (SELECT repo, area, flow.id AS flow_id, trim(flow.summary) AS summary FROM mflows) WHERE summary <> '' AND flow_id IS NOT NULL GROUP BY flow_id")
def first_non_empty(spark, d):
    m = load(spark, d, "flow_maps", "map_no bigint, repo string, area string, made_at timestamp_ntz, flows array<struct<id: string, summary: string>>")
    latest = m.groupBy("repo", "area").agg(F.max_by("flows", F.struct("made_at", "map_no")).alias("flows"))
    f = latest.select("repo", "area", F.explode("flows").alias("f")).select("repo", "area", F.col("f.id").alias("flow_id"), F.trim("f.summary").alias("summary"))
    return f.filter("summary <> '' and flow_id is not null").groupBy("flow_id").agg(F.min_by("summary", F.struct("repo", "area")).alias("summary"))


@query(
    "SELECT step, array_to_string(list_sort(list_filter(ends, lambda x: NOT list_contains(un, x))), ', ') AS tested, len(list_filter(ends, lambda x: NOT list_contains(un, x))) = len(ends) AS all_tested FROM sets",
    sets=f"SELECT step, map_no, flow_pos, step_pos, list_distinct(list_filter(list_transform(coalesce(endpoints, []), lambda x: {V.e_('x')}), lambda x: x IS NOT NULL)) AS ends, list_filter(list_transform(coalesce(un0, []), lambda x: {V.e_('x')}), lambda x: x IS NOT NULL) AS un FROM (SELECT step, map_no, flow_pos, step_pos, endpoints, un0 FROM (SELECT concat_ws(' ', repo, concat_ws('/', flow_id, s.id)) AS step, map_no, flow_pos, step_pos, s.endpoints AS endpoints, s.untested_endpoints AS un0 FROM msteps0 WHERE s IS NOT NULL))",
)
def array_set_ops(spark, d):
    """Of each step the entry points that aren't untested, and whether these are all."""
    m = load(spark, d, "flow_maps", f"map_no bigint, repo string, area string, made_at timestamp_ntz, flows array<struct<id: string, steps: array<struct<id: string, endpoints: array<string>, untested_endpoints: array<string>>>>>")
    latest = m.groupBy("repo", "area").agg(F.max_by("flows", F.struct("made_at", "map_no")).alias("flows"))
    s = latest.select("repo", F.explode("flows").alias("f")).select("repo", F.col("f.id").alias("flow_id"), F.explode("f.steps").alias("s")).filter("s is not null")
    s = s.select(F.concat_ws(" ", "repo", F.concat_ws("/", "flow_id", F.col("s.id"))).alias("step"), tidy.entries("s.endpoints").alias("ends"), tidy.entries("s.untested_endpoints").alias("un"))
    tested = F.array_except("ends", "un")
    return s.select("step", F.array_join(F.array_sort(tested), ", ").alias("tested"), (F.size(F.array_except("ends", tested)) == 0).alias("all_tested"))


SETS = {"sets": "SELECT repo || ' ' || run_id || ' ' || flow_id AS proposal, repo, run_id, flow_id, endpoint FROM (SELECT split_part(endpoint, ' ', 1) AS repo, * FROM placements) WHERE starts_with(flow_id, 'new:')"}
SETS["sizes"] = "SELECT proposal, count(DISTINCT endpoint) AS k FROM sets GROUP BY proposal"
SETS["both_"] = "SELECT a.proposal AS x, b.proposal AS y, count(DISTINCT a.endpoint) AS o FROM sets a JOIN sets b ON a.endpoint = b.endpoint AND a.run_id <> b.run_id AND a.proposal < b.proposal GROUP BY ALL"


def proposals(spark: SparkSession, d: str) -> DataFrame:
    p = V.placements(spark, d).filter("startswith(flow_id, 'new:')").withColumn("repo", F.substring_index("endpoint", " ", 1))
    return p.select(F.concat_ws(" ", "repo", "run_id", "flow_id").alias("proposal"), "run_id", "flow_id", "endpoint")


@query("SELECT x, y, o / (p.k + q.k - o)::DOUBLE AS jaccard FROM both_ JOIN sizes p ON p.proposal = x JOIN sizes q ON q.proposal = y WHERE o / (p.k + q.k - o)::DOUBLE >= 0.3", **SETS)
def jaccard_join(spark, d):
    """Proposed flows of different mappers whose entry points overlap."""
    p = Stash(spark).put(proposals(spark, d))
    run = F.split(F.col("x"), " ")[1] != F.split(F.col("y"), " ")[1]
    return consensus.overlaps(p.withColumnRenamed("proposal", "x"), p.withColumnRenamed("proposal", "y"), "x", "y", "endpoint", (F.col("x") < F.col("y")) & run, 0.3)


@query(
    "SELECT v AS proposal, min(w) AS cluster FROM cc GROUP BY v",
    recursive=", ".join([*(f"{k} AS ({t})" for k, t in SETS.items()), "lk AS (SELECT x, y FROM both_ JOIN sizes p ON p.proposal = x JOIN sizes q ON q.proposal = y WHERE o / (p.k + q.k - o)::DOUBLE >= 0.3), l2 AS (SELECT x, y FROM lk UNION SELECT y, x FROM lk UNION SELECT proposal, proposal FROM sets), cc(v, w) AS (SELECT x, y FROM l2 UNION SELECT cc.v, l2.y FROM cc JOIN l2 ON cc.w = l2.x)"]),
)
def cluster_proposals(spark, d):
    links = jaccard_join(spark, d).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    return graph.connected(spark, links, proposals(spark, d).select(F.col("proposal").alias("node"))).select(F.col("node").alias("proposal"), F.col("component").alias("cluster"))


LOOSE = {
    "lo0": "SELECT repo, run_id, flow_id, s.step_no AS step_no, unnest(list_concat(coalesce(s.code_path, []), coalesce(s.ui, []))) AS v FROM rsteps WHERE flow_id IS NOT NULL AND len(list_filter(coalesce(s.endpoints, []), lambda x: trim(x) <> '')) <= 1",
    "lo": f"SELECT DISTINCT repo || ' ' || flow_id AS flow, run_id, step_no, {V.n_('v')} AS t FROM lo0 WHERE {V.n_('v')} IS NOT NULL AND flow_id IS NOT NULL",
    "losz": "SELECT step_no, count(*) AS k FROM lo GROUP BY step_no",
    "lob": "SELECT a.step_no AS x, b.step_no AS y, count(*) AS o FROM lo a JOIN lo b ON a.flow = b.flow AND a.t = b.t AND a.run_id <> b.run_id AND a.step_no < b.step_no GROUP BY ALL",
    "lol": "SELECT x, y FROM lob JOIN losz p ON p.step_no = x JOIN losz q ON q.step_no = y WHERE o / (p.k + q.k - o)::DOUBLE >= 0.3",
}


@query(
    "SELECT v AS step_no, min(w) AS cluster FROM cc GROUP BY v HAVING count(*) > 1",
    recursive=", ".join([*(f"{k} AS ({t})" for k, t in LOOSE.items()), "l2 AS (SELECT x, y FROM lol UNION SELECT y, x FROM lol UNION SELECT step_no, step_no FROM lo), cc(v, w) AS (SELECT x, y FROM l2 UNION SELECT cc.v, l2.y FROM cc JOIN l2 ON cc.w = l2.x)"]),
)
def cluster_loose(spark, d):
    """Steps of one entry point or none that different mappers have in the same flow with overlapping code and screens; steps alone are left out."""
    few = F.size(F.filter(F.coalesce("endpoints", F.array().cast("array<string>")), lambda x: F.trim(x) != "")) <= 1
    r = V.runs(spark, d).filter("flow_id is not null").filter(few)
    t = Stash(spark).put(r.select(F.concat_ws(" ", "repo", "flow_id").alias("flow"), "run_id", "step_no", F.explode(F.array_union(tidy.nodes("code_path"), tidy.nodes("ui"))).alias("t")))
    keyed = t.select(F.struct("step_no", "run_id").alias("step"), F.concat_ws(" ", "flow", "t").alias("t"))
    others = (F.col("x.step_no") < F.col("y.step_no")) & (F.col("x.run_id") != F.col("y.run_id"))
    got = consensus.overlaps(keyed.withColumnRenamed("step", "x"), keyed.withColumnRenamed("step", "y"), "x", "y", "t", others, 0.3)
    links = got.select(F.col("x.step_no").alias("src"), F.col("y.step_no").alias("dst"))
    found = Stash(spark).put(graph.connected(spark, links, t.select(F.col("step_no").alias("node")).distinct()))
    many = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    return found.join(many, "component", "left_semi").select(F.col("node").alias("step_no"), F.col("component").alias("cluster"))


BEST = {
    "g": "SELECT DISTINCT step, endpoint FROM mends",
    "r": "SELECT run_id, step_no, endpoint FROM placements",
    "ng": "SELECT step, count(*) AS k FROM g GROUP BY step",
    "nr": "SELECT step_no, count(*) AS k FROM r GROUP BY step_no",
    "m": "SELECT step, run_id, step_no, count(*) AS o FROM g JOIN r USING (endpoint) GROUP BY ALL",
    "sc": "SELECT step, run_id, step_no, o / (ng.k + nr.k - o)::DOUBLE AS j FROM m JOIN ng USING (step) JOIN nr USING (step_no)",
}


@query("SELECT step, run_id, arg_min(step_no, (-j, step_no)) AS step_no, max(j) AS jaccard FROM sc GROUP BY step, run_id", **BEST)
def best_overlap_match(spark, d):
    """For each step of the maps and each mapper the mapper's step that overlaps most, of equal ones the first."""
    g = V.map_endpoints(spark, d).select("step", "endpoint").distinct()
    r = V.placements(spark, d).select(F.struct("run_id", "step_no").alias("key"), "endpoint")
    got = consensus.overlaps(g, r, "step", "key", "endpoint")
    return got.groupBy("step", F.col("key.run_id").alias("run_id")).agg(F.min_by(F.col("key.step_no"), F.struct(-F.col("jaccard"), F.col("key.step_no"))).alias("step_no"), F.max("jaccard").alias("jaccard"))


@query(
    "SELECT a.step_no AS step_no, len(list_intersect(a.c, a.u)) / greatest(1, len(list_distinct(list_concat(a.c, a.u))))::DOUBLE AS jaccard FROM (SELECT s.step_no AS step_no, list_distinct(list_filter(list_transform(coalesce(s.code_path, []), lambda x: regexp_extract(" + V.NODE.replace("{0}", "x") + ", '^([^/]*)', 1)), lambda x: x IS NOT NULL AND x <> '')) AS c, list_distinct(list_filter(list_transform(coalesce(s.ui, []), lambda x: regexp_extract(" + V.NODE.replace("{0}", "x") + ", '^([^/]*)', 1)), lambda x: x IS NOT NULL AND x <> '')) AS u FROM rsteps) a"
)
def jaccard(spark, d):
    """How far the top directories of a step's code and of its screens are the same; 0 if both are empty."""
    top = lambda c: F.array_distinct(F.transform(tidy.nodes(c), lambda x: F.substring_index(x, "/", 1)))
    r = V.runs(spark, d).select("step_no", top("code_path").alias("c"), top("ui").alias("u"))
    return r.select("step_no", consensus.jaccard(F.col("c"), F.col("u")).alias("jaccard"))


@query("SELECT flow, round(-sum(p * log2(p)), 6) AS entropy, sum(n)::BIGINT AS placed FROM (SELECT flow, n, n / sum(n) OVER (PARTITION BY flow) AS p FROM (SELECT flow, p.flow_id AS voted, count(*) AS n FROM placements p JOIN flow_of USING (endpoint) WHERE flow IS NOT NULL AND p.flow_id IS NOT NULL GROUP BY ALL)) GROUP BY flow")
def flow_entropy(spark, d):
    """How scattered the votes on a flow's entry points are, in bits."""
    n = V.placements(spark, d).filter("flow_id is not null").join(V.flow_of(spark, d).dropna(), "endpoint").groupBy("flow", "flow_id").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("flow").agg(F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    return n.join(total, "flow").groupBy("flow").agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"), F.sum("n").alias("placed"))


@query("SELECT run_id, count(*) AS placed, count(*) FILTER (p.flow_id = flow) AS right_, count(*) FILTER (p.flow_id = flow) / greatest(1, count(*))::DOUBLE AS recall FROM placements p JOIN flow_of USING (endpoint) GROUP BY run_id")
def recall_score(spark, d):
    """How often each mapper places an entry point where the maps have it."""
    j = V.placements(spark, d).join(V.flow_of(spark, d), "endpoint")
    right = F.count(F.when(F.col("flow_id") == F.col("flow"), 1))
    return j.groupBy("run_id").agg(F.count(F.lit(1)).alias("placed"), right.alias("right_"), (right / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("recall"))


@query("SELECT run_id, status, count(*) AS placed, count(*) FILTER (p.flow_id = s.flow_id) AS with_majority FROM placements p JOIN status_of s USING (endpoint) GROUP BY ALL", **VOTES)
def score_join(spark, d):
    s = voted(spark, d).select("endpoint", F.col("flow_id").alias("top"), "status")
    return V.placements(spark, d).join(s, "endpoint").groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("placed"), F.count(F.when(F.col("flow_id") == F.col("top"), 1)).alias("with_majority"))


@query("SELECT a, b, count(*) AS w, count(DISTINCT step) AS steps FROM (SELECT flow_id AS a, regexp_extract(node, '^[^ ]+ ([^/]+)', 1) AS b, step FROM anchors) WHERE a IS NOT NULL AND b <> '' GROUP BY ALL")
def edge_rollup(spark, d):
    """Wires between flows and top directories: how many hops, of how many steps."""
    e = V.anchors(spark, d).select(F.col("flow_id").alias("a"), F.regexp_extract("node", r"^[^ ]+ ([^/]+)", 1).alias("b"), "step")
    return e.filter("a is not null and b <> ''").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"), F.countDistinct("step").alias("steps"))


@query(f"SELECT scope, ends, count(*) AS steps FROM (SELECT repo || ' ' || area AS scope, s.step_no AS step_no, array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(s.endpoints, []), lambda x: {V.e_('x')}), lambda x: x IS NOT NULL))), ', ') AS ends FROM rsteps) WHERE ends <> '' GROUP BY scope, ends HAVING count(*) > 1")
def group_by_set(spark, d):
    """Steps of an area's passes with identical entry points."""
    r = V.runs(spark, d).select(F.concat_ws(" ", "repo", "area").alias("scope"), F.array_join(F.array_sort(tidy.entries("endpoints")), ", ").alias("ends"))
    return r.filter("ends <> ''").groupBy("scope", "ends").agg(F.count(F.lit(1)).alias("steps")).filter("steps > 1")
