"""What a change does, from two revisions of the files and the lines between them: symbols, steps, reach, blind spots, verdict.

Three notions of changed are kept apart: `touched` symbols hold a changed line on either side; `changed` are those less the ones
whose edit is cosmetic; `new` exist at head alone and only inherit reach.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegraph.adapters import scan
from changegraph.functions import paths
from changegraph.operators import graph, ranges
from changegraph.operators.blind import blind_spots
from changegraph.parse import graph_of
from changegraph.session import Stash
from changegraph.sources.config import Settings

@dataclass
class Change:
    """The tables of a change; nodes are `path:name`."""

    symbols: DataFrame  # node, status (new, deleted, modified), cosmetic, contract
    endpoints: DataFrame  # endpoint, status (added, removed, moved, both)
    touched_steps: DataFrame  # step, node
    reach: DataFrame  # node, endpoint, flow
    hidden_steps: DataFrame  # step, node
    off_map: DataFrame  # node
    moved: DataFrame  # endpoint, node, moved
    blind: DataFrame  # rule, subject
    spread: DataFrame  # endpoint, flow
    verdict: str


def changed_lines(hunks: DataFrame, deleted_files: bool = False) -> DataFrame:
    """ref, path, line: the lines of each side. hunks as the git source gives them, without context.

    By default a file that is deleted as a whole gives no lines: what went with it shows in the entry points and the reach."""
    h = hunks if deleted_files else hunks.filter("not deleted")
    side = lambda ref, start, n: h.filter(F.col(n) > 0).select(F.col(ref).alias("ref"), "path", F.explode(F.sequence(F.col(start), F.col(start) + F.col(n) - 1)).alias("line"))
    return side("base", "old_start", "old_lines").unionByName(side("head", "new_start", "new_lines")).distinct()


def symbols_at(lines: DataFrame, defs: DataFrame, facts: DataFrame) -> DataFrame:
    """ref, path, name: the innermost definition of each line; a line outside of all is `<module>` if it runs or its file can't be parsed."""
    places = lines.withColumn("place", F.concat_ws(":", "ref", "path", F.col("line").cast("string")))
    things = defs.select("ref", "path", "name", "start", "end").withColumn("n", F.pmod(F.xxhash64("name"), F.lit(1 << 30)))
    found = ranges.innermost(places, things, ["ref", "path"], ["place"], "line", "n").select("ref", "path", "line", "name")
    read = facts.select("ref", "path").distinct().join(facts.filter("kind = 'unparsed'").select("ref", "path"), ["ref", "path"], "left_anti").withColumn("read", F.lit(True))
    live = facts.filter("kind = 'live'").select("ref", "path", F.explode(F.sequence("start", "end")).alias("line")).distinct().withColumn("runs", F.lit(True))
    met = found.join(read, ["ref", "path"], "left").join(live, ["ref", "path", "line"], "left")
    named = F.coalesce("name", F.when(F.col("runs") | F.col("read").isNull(), "<module>"))
    return met.select("ref", "path", named.alias("name")).filter("name is not null").distinct()


def versions(symbols: DataFrame, facts: DataFrame, base: str, head: str) -> DataFrame:
    """path, name, same, contract of Python symbols on both sides: equal but for docstrings and layout; another signature.

    Both come with the facts of a file, which has been read once."""
    said = facts.filter("kind = 'look'").select("ref", "path", "name", F.col("target").alias("shape"), F.col("recv").alias("signature"))
    of = lambda ref, n: said.filter(F.col("ref") == ref).groupBy("path", "name").agg(F.first(F.struct("shape", "signature")).alias(n))
    both = symbols.join(of(base, "b"), ["path", "name"]).join(of(head, "h"), ["path", "name"])
    return both.select("path", "name", (F.col("b.shape") == F.col("h.shape")).alias("same"), (~F.col("b.signature").eqNullSafe(F.col("h.signature"))).alias("contract"))


def analyse(spark: SparkSession, files: DataFrame, hunks: DataFrame, base: str, head: str, specs: list[dict], steps: DataFrame, settings: Settings | None = None, index: graph_of.Index | None = None) -> Change:
    """files: ref, path, text of both revisions; steps: step, flow, endpoints, anchors (arrays) of the map.

    settings: what is code, where the call graph begins, where generated files go; by default all code counts. index: definitions and
    calls of files that no parser here reads. Entry points that can't be listed at a revision are a blind spot and no error."""
    stash, settings = Stash(spark), settings or Settings()
    facts = stash.put(graph_of.python_facts(settings.graphed_files(files)))
    defs, edges, bad = graph_of.build(settings.graphed_files(files), facts, index)
    defs, edges = stash.put(defs), stash.put(edges)
    listed, failures = [], []
    for ref in (base, head):
        try:
            found, _ = scan(specs, files.filter(F.col("ref") == ref), defs.filter(F.col("ref") == ref))
            listed.append(stash.put(found.select("ref", "endpoint", "handler")))
        except Exception as e:  # whatever an adapter meets in a revision's files
            failures.append((f"{ref}: {type(e).__name__}",))
            listed.append(stash.put(spark.createDataFrame([], "ref string, endpoint string, handler string")))
    entries = listed[0].unionByName(listed[1])
    side = lambda df, ref: df.filter(F.col("ref") == ref).drop("ref")
    b_defs, h_defs = (side(defs, r).select("path", "name", "node").distinct() for r in (base, head))
    kind = settings.kind(F.col("path"))
    code = kind == "code"

    lines = changed_lines(hunks.filter(code))
    touched = symbols_at(lines, defs, facts).select("path", "name").distinct()
    here = lambda df, n: df.select("path", "name", F.lit(True).alias(n)).distinct()
    known = touched.join(here(b_defs, "in_b"), ["path", "name"], "left").join(here(h_defs, "in_h"), ["path", "name"], "left").join(versions(touched, facts, base, head), ["path", "name"], "left")
    module = F.col("name") == "<module>"
    status = F.when(module, "modified").when(F.col("in_b").isNull(), "new").when(F.col("in_h").isNull(), "deleted").otherwise("modified")
    symbols = stash.put(known.select(F.concat_ws(":", "path", "name").alias("node"), "path", "name", status.alias("status"), F.coalesce(F.col("same") & ~module, F.lit(False)).alias("cosmetic"), F.coalesce(F.col("contract") & (status == "modified") & ~module, F.lit(False)).alias("contract")))
    changed = symbols.filter("not cosmetic")

    b, h = (side(entries, r) for r in (base, head))
    ends = b.select("endpoint", F.col("handler").alias("hb")).join(h.select("endpoint", F.col("handler").alias("hh")), "endpoint", "full")
    ends = stash.put(ends.withColumn("status", F.when(F.col("hb").isNull(), "added").when(F.col("hh").isNull(), "removed").when(F.col("hb") != F.col("hh"), "moved").otherwise("both")))

    every = edges.select("src", "dst").distinct()
    flow_of = steps.select("flow", F.explode("endpoints").alias("endpoint")).groupBy("endpoint").agg(F.max("flow").alias("flow"))
    handled = entries.select("endpoint", "handler").distinct()
    existing = changed.filter("status <> 'new'").select(F.col("node").alias("origin"))
    reach = stash.put(graph.impact(spark, every, existing, handled, flow_of))

    anchors = steps.select("step", F.explode("anchors").alias("anchor")).select("step", paths.file_of("anchor").alias("path"), paths.leaf_of("anchor").alias("leaf"))
    met = stash.put(changed.withColumn("leaf", F.substring_index("name", ".", -1)).join(anchors, ["path", "leaf"]).select("step", "node").distinct())
    by_end = steps.select("step", F.explode("endpoints").alias("endpoint"))
    hidden = reach.join(by_end, "endpoint").select("step", "node").distinct().join(met, ["step", "node"], "left_anti")
    off = changed.select("node").join(met.select("node"), "node", "left_anti")

    both_sides = b_defs.select("node").intersect(h_defs.select("node"))
    moved = stash.put(graph.reach_diff(spark, side(edges, base), side(edges, head), b, h, both_sides))

    files_changed = hunks.select("path").distinct().select("path", kind.alias("kind"), (settings.in_roots(F.col("path")) & graph_of.has_builder(F.col("path"), index)).alias("graphed"))
    named = lambda df: df.select(paths.file_of("node").alias("path"), paths.symbol_of("node").alias("name"))
    failed = spark.createDataFrame(failures, "subject string")
    blind = stash.put(blind_spots([], files_changed, bad, failed, changed.select("path", "name", "status"), named(reach), b, h, h_defs))
    shifted = moved.select("endpoint").unionByName(ends.filter("status in ('removed', 'moved')").select("endpoint")).distinct().join(flow_of, "endpoint", "left").select("endpoint", F.coalesce("flow", F.lit("unplaced")).alias("flow"))
    spread = stash.put(reach.select("endpoint", "flow").unionByName(shifted).distinct())
    verdict = "blind" if stash.rows(blind) else "spreads" if stash.rows(spread) else "contained"
    return Change(symbols.select("node", "status", "cosmetic", "contract"), ends.select("endpoint", "status"), met, reach, hidden, off, moved, blind, spread, verdict)
