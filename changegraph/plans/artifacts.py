"""Queries over artifacts: what is written as JSON and read back, and an index in place of a parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegraph.plans import views as V
from changegraph.session import Stash
from changegraph.sources import artifacts, index
from changegraph.sources.tables import load


def _entries(spark: SparkSession, d: str) -> DataFrame:
    e = V.entries(spark, d).withColumn("repo", F.substring_index("endpoint", " ", 1))
    none = F.array().cast("array<string>")
    return e.select("repo", F.expr("substring(endpoint, length(repo) + 2)").alias("endpoint"), F.expr("substring(handler, length(repo) + 2)").alias("handler"), "line", none.alias("aliases"), F.lit(None).cast("string").alias("implicit"))


def inventory_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Entry points of each kind, counted in the inventories' JSON."""
    j = artifacts.inventory_json(_entries(spark, d), ["repo"])
    return j.select("repo", F.explode(artifacts.kinds_of("json")).alias("kind", "n"))


def inventory_read(spark: SparkSession, d: str) -> DataFrame:
    """The inventories read back from their JSON: place in the file, entry point, handler, line."""
    j = Stash(spark).put(artifacts.inventory_json(_entries(spark, d), ["repo"]))
    e = j.select("repo", F.posexplode(F.from_json("json", artifacts.INVENTORY)["endpoints"]).alias("pos", "e"))
    return e.select("repo", "pos", "e.endpoint", "e.handler", "e.line")


def graph_read(spark: SparkSession, d: str) -> DataFrame:
    """The calls of the last revisions, read back from the graphs' JSON."""
    bare = lambda c: F.expr(f"substring({c}, instr({c}, ' ') + 1)").alias(c)
    repo = lambda c: F.substring_index(c, " ", 1).alias("repo")
    e = V.edges(spark, d, "head").select(repo("src"), bare("src"), bare("dst"))
    g = V.defs(spark, d).select(repo("node"), bare("node"), "start", "end")
    j = Stash(spark).put(artifacts.graph_json(g, e, ["repo"]))
    return j.select("repo", F.explode(F.from_json("json", artifacts.GRAPH)["edges"]).alias("e")).select("repo", F.get("e", 0).alias("src"), F.get("e", 1).alias("dst"))


def facts_kept(spark: SparkSession, d: str) -> DataFrame:
    """How many fields the facts of each change keep."""
    f = load(spark, d, "change_facts", "change_no bigint, facts string").distinct()
    j = artifacts.facts_json(f, "change_no", "facts")
    return j.select("change_no", F.size(F.from_json("json", "map<string, string>")).alias("fields")).distinct()


def index_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls from the tables of an index: the definitions are its nodes, the calls of both sides its edges by number."""
    g = V.defs(spark, d)
    method = F.contains("sym", F.lit("."))
    nodes = g.select(F.col("def_no").cast("string").alias("id"), F.when(method, "method").otherwise("function").alias("kind"), F.col("leaf").alias("name"), F.replace("sym", F.lit("."), F.lit("::")).alias("qualified_name"), F.col("file").alias("file_path"), F.col("start").alias("start_line"), F.col("end").alias("end_line"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("docstring"))
    ids = lambda c, n: g.select(F.col("node").alias(c), F.col("def_no").cast("string").alias(n))
    edges = V.edges(spark, d).join(ids("src", "source"), "src").join(ids("dst", "target"), "dst").select("source", "target", F.lit("calls").alias("kind"))
    return index.calls(Stash(spark).put(nodes), edges)


QUERIES = {f.__name__: f for f in (inventory_kinds, inventory_read, graph_read, facts_kept, index_calls)}
ORACLES = {
    "inventory_kinds": V.sql("SELECT split_part(endpoint, ' ', 1) AS repo, kind, count(*) AS n FROM entries GROUP BY ALL"),
    "inventory_read": V.sql("SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY substr(e, instr(e, ' ') + 1), e) - 1 AS pos, e AS endpoint, substr(handler, length(repo) + 2) AS handler, line FROM (SELECT split_part(endpoint, ' ', 1) AS repo, substr(endpoint, instr(endpoint, ' ') + 1) AS e, handler, line FROM entries)"),
    "graph_read": V.sql("SELECT split_part(src, ' ', 1) AS repo, substr(src, instr(src, ' ') + 1) AS src, substr(dst, instr(dst, ' ') + 1) AS dst FROM head WHERE split_part(src, ' ', 1) IN (SELECT split_part(node, ' ', 1) FROM defs)"),
    "facts_kept": "SELECT DISTINCT change_no, len(list_filter(json_keys(j), lambda k: k <> 'hunks')) AS fields FROM (SELECT change_no, TRY_CAST(facts AS JSON) AS j FROM change_facts) WHERE json_type(j) = 'OBJECT'",
    "index_calls": V.sql("SELECT src, dst FROM edges WHERE src IN (SELECT node FROM defs) AND dst IN (SELECT node FROM defs)"),
}
