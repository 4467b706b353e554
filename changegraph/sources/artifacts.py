"""Results as JSON that can be handed on and read back: inventories, passes, maps, graphs, facts of changes.

Each is one JSON text per row, so that many repositories' artifacts are one table; `write` puts every text in a file of its
own, which is for what people and other tools read and not for tables of millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INVENTORY = "endpoints array<struct<endpoint: string, handler: string, line: int, aliases: array<string>, implicit: string>>"
PASS = "run_id string, method string, flows array<struct<id: string, summary: string, steps: array<struct<id: string, name: string, actor: string, endpoints: array<string>, ui: array<string>, code_path: array<string>, writes: array<string>, confidence: string, notes: string>>>>, unplaced_endpoints array<struct<endpoint: string, why: string>>, observations array<string>"
MAP = "runs array<string>, agree_threshold int, flows array<struct<id: string, summary: string, steps: array<struct<id: string, name: string, alt_names: array<string>, actor: string, endpoints: array<string>, ui: array<string>, code_path: array<string>, disputed_hops: array<string>, writes: array<string>, busyness: struct<hops: int, files: int>, evidence: string, untested_endpoints: array<string>, runs: array<string>>>>>"
GRAPH = "defs map<string, array<int>>, edges array<array<string>>"


def inventory_json(entries: DataFrame, by: list[str]) -> DataFrame:
    """by, json, endpoints: the entry points of each inventory, by what follows their kind. One inventory is one repository's, bounded by its code."""
    rest = F.expr("substring(endpoint, instr(endpoint, ' ') + 1)")
    row = F.struct(rest.alias("_rest"), "endpoint", "handler", "line", "aliases", "implicit")
    listed = entries.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("e"))
    kept = F.transform("e", lambda x: F.struct(*[x[c].alias(c) for c in ("endpoint", "handler", "line", "aliases", "implicit")]))
    return listed.select(*by, F.to_json(F.struct(kept.alias("endpoints"))).alias("json"), F.size("e").alias("endpoints"))


def kinds_of(json: Column | str) -> Column:
    """KIND -> entry points of an inventory's JSON."""
    kinds = F.transform(F.from_json(json, INVENTORY)["endpoints"], lambda e: F.substring_index(e["endpoint"], " ", 1))
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))


def graph_json(defs: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """by, json: node -> [first line, last line], and the calls, both sorted. defs: by, node, start, end; edges: by, src, dst."""
    d = defs.groupBy(*by, "node").agg(F.min(F.struct("start", "end")).alias("p")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("node", F.array("p.start", "p.end").alias("lines")))).alias("d"))
    e = edges.select(*by, F.array("src", "dst").alias("e")).distinct().groupBy(*by).agg(F.array_sort(F.collect_list("e")).alias("edges"))
    none = F.array().cast("array<array<string>>")
    made = F.struct(F.map_from_entries("d").alias("defs"), F.coalesce("edges", none).alias("edges"))
    return d.join(e, by, "left").select(*by, F.to_json(made).alias("json"))


def map_json(flows: DataFrame, steps: DataFrame, runs: DataFrame, order: Column | None = None) -> DataFrame:
    """scope, json: the reconciled map of each scope, flows in order, steps by their place in it.

    flows: scope, flow, summary; steps as `reconcile` gives them; runs: scope, runs (array), need."""
    nulls = lambda c, t="array<string>": F.coalesce(c, F.array().cast(t))
    busy = F.struct(F.size(nulls("hops")).alias("hops"), F.col("files").alias("files"))
    place = F.struct(F.round("position", 6).alias("p"), F.get("endpoints", 0).alias("e"), F.col("id").alias("i"))
    body = F.struct(F.col("id"), F.col("step_name").alias("name"), "actor", "endpoints", F.col("hops").alias("code_path"), F.col("disputed").alias("disputed_hops"), busy.alias("busyness"), "evidence", "runs")
    per_flow = steps.groupBy("scope", "flow").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), body.alias("step")))).alias("s"))
    rank = F.struct((order if order is not None else F.lit(0)).alias("o"), F.col("flow").alias("f"))
    each = per_flow.join(flows, ["scope", "flow"], "left").select("scope", rank.alias("at"), F.struct(F.col("flow").alias("id"), "summary", F.transform("s", lambda x: x["step"]).alias("steps")).alias("flow"))
    whole = each.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("at", "flow"))).alias("f"))
    made = F.struct("runs", F.col("need").alias("agree_threshold"), F.transform("f", lambda x: x["flow"]).alias("flows"))
    return whole.join(runs, "scope").select("scope", F.to_json(made).alias("json"))


def facts_json(facts: DataFrame, key: str, text: str) -> DataFrame:
    """key, json: the facts of changes as they are kept, without diff text; texts that are no JSON objects are left out."""
    v = facts.select(key, F.try_parse_json(text).alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    fields = F.map_filter(F.try_variant_get("v", "$", "map<string, variant>"), lambda k, _: k != "hunks")
    return v.select(key, F.to_json(fields).alias("json"))


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, and the fields of one of the schemas, of a folder's JSON files, each one object over as many lines as it likes."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.col("_metadata.file_name").alias("file"), "*")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(defs, edges) of graph dumps: file, node, start, end and file, src, dst."""
    g = read(spark, path, GRAPH)
    defs = g.select("file", F.explode("defs").alias("node", "lines")).select("file", "node", F.get("lines", 0).alias("start"), F.get("lines", 1).alias("end"))
    return defs, g.select("file", F.explode("edges").alias("e")).select("file", F.get("e", 0).alias("src"), F.get("e", 1).alias("dst"))


def embedded(html: Column | str, name: str = "DATA") -> Column:
    """The JSON that a page keeps in `const NAME = ...;`, null if it has none."""
    found = F.regexp_extract(html, rf"(?s)const {name}\s*=\s*(.*?);\s*</script>", 1)
    return F.nullif(F.replace(found, F.lit("<\\/"), F.lit("</")), F.lit(""))


def write(df: DataFrame, folder: str, name: str, text: str) -> None:
    """Each row's text as a file of its own, `name` telling it apart; a folder per row, as Spark writes them."""
    df.select(F.col(name).alias("name"), F.col(text).alias("value")).write.partitionBy("name").mode("overwrite").text(folder)
