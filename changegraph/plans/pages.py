"""Queries of the pages: the map as a typed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegraph.functions import tidy
from changegraph.operators import canvas, story
from changegraph.plans import views as V
from changegraph.plans.changes import FACTS, recs
from changegraph.plans.graphs import LEVELS, handled_steps
from changegraph.plans.relational import CHANGED, anti_join, changed_nodes
from changegraph.sources import facts
from changegraph.sources.tables import load


def canvas_wires(spark: SparkSession, d: str) -> DataFrame:
    steps = V.map_steps(spark, d).select("step", tidy.nodes("ui").alias("ui"), "writes")
    return canvas.wires(spark, steps, handled_steps(spark, d).select("step", "handler").distinct(), V.edges(spark, d))


def painted_files(spark: SparkSession, d: str) -> DataFrame:
    """The file card of the map that shows each changed node, none where no step names the file."""
    cards = V.anchors(spark, d).select(F.col("file").alias("card"), F.col("file").alias("path")).distinct()
    new = anti_join(spark, d).withColumn("new", F.lit(True))
    changed = changed_nodes(spark, d).join(new, "node", "left").select("node", F.when(F.col("new"), "new").otherwise("changed").alias("kind"))
    return canvas.painted(cards, changed)


def chapter_steps(spark: SparkSession, d: str) -> DataFrame:
    """The steps of the maps whose code holds a symbol of a change's chapter; a chapter is a status of symbols here."""
    repos = load(spark, d, "change_facts", "change_no bigint, repo string").distinct()
    s = facts.symbols(recs(spark, d)).join(repos, "change_no").select("change_no", F.col("status").alias("chapter"), F.concat_ws(" ", "repo", "id").alias("node"))
    code = V.anchors(spark, d).select("step", "node")
    return canvas.chapter_steps(s, code, []).select("chapter", "step")


def folded_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of which a change's page shows the path alone, where no story is told."""
    none = spark.createDataFrame([], story.STORY)
    return story.folded(facts.files(recs(spark, d)).select("change_no", "path", "kind"), none)


QUERIES = {f.__name__: f for f in (canvas_wires, painted_files, chapter_steps, folded_files)}
WALK = (
    LEVELS
    + """, hs AS (SELECT DISTINCT step, handler FROM mends JOIN entries USING (endpoint) WHERE handler IS NOT NULL),
 near AS (SELECT origin, node FROM (SELECT origin, node, row_number() OVER (PARTITION BY origin ORDER BY min(d), node) AS rn FROM lv WHERE d BETWEEN 1 AND 4 AND origin <> node GROUP BY origin, node) WHERE rn <= 21 UNION SELECT handler, handler FROM hs),
 code AS (SELECT DISTINCT step, node FROM hs JOIN near ON handler = origin),
 home AS (SELECT step, min(regexp_extract(handler, '^(.*):[^:]*$', 1)) AS home FROM hs GROUP BY step),
 uis AS (SELECT DISTINCT map_no, flow_pos, step_pos, step, u FROM (SELECT map_no, flow_pos, step_pos, step, """
    + V.n_("u")
    + """ AS u FROM (SELECT map_no, flow_pos, step_pos, step, unnest(ui) AS u FROM msteps)) WHERE u IS NOT NULL),
 wr AS (SELECT step, w FROM (SELECT step, unnest(writes) AS w FROM msteps) WHERE w IS NOT NULL),
 wires AS (SELECT step AS a, regexp_extract(handler, '^(.*):[^:]*$', 1) AS b, 'entry' AS kind, step FROM hs
 UNION ALL SELECT regexp_extract(src, '^(.*):[^:]*$', 1), regexp_extract(dst, '^(.*):[^:]*$', 1), 'call', x.step FROM code x JOIN edges ON src = x.node JOIN code y ON dst = y.node AND x.step = y.step WHERE regexp_extract(src, '^(.*):[^:]*$', 1) <> regexp_extract(dst, '^(.*):[^:]*$', 1)
 UNION ALL SELECT regexp_extract(u, '^(.*):[^:]*$', 1), step, 'ui', step FROM uis
 UNION ALL SELECT coalesce(home, step), split_part(w, '.', 1), 'writes', step FROM wr LEFT JOIN home USING (step))"""
)
ORACLES = {
    "canvas_wires": V.sql("SELECT a, b, kind, count(*) AS w, count(DISTINCT step) AS steps FROM wires GROUP BY a, b, kind", recursive=WALK),
    "painted_files": V.sql(f"SELECT node, CASE WHEN node IN (SELECT src FROM head) AND node NOT IN (SELECT src FROM base) THEN 'new' ELSE 'changed' END AS kind, CASE WHEN {V.f_('node')} IN (SELECT file FROM anchors) THEN {V.f_('node')} END AS card FROM {CHANGED}"),
    "chapter_steps": V.sql("SELECT DISTINCT s ->> 'status' AS chapter, step FROM syms JOIN (SELECT DISTINCT change_no, repo FROM change_facts) USING (change_no) JOIN anchors ON node = repo || ' ' || (s ->> 'id')", **FACTS),
    "folded_files": V.sql("SELECT change_no, f ->> 'path' AS path FROM fls WHERE f ->> 'kind' IN ('generated', 'test', 'doc', 'outside')", **FACTS),
}
