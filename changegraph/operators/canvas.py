"""The map as a typed graph: steps, files, screens and data, and the wires between them with the steps that run along each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegraph.functions import paths
from changegraph.operators import graph
from changegraph.session import Stash


def wires(spark: SparkSession, steps: DataFrame, handled: DataFrame, edges: DataFrame, depth: int = 4, most: int = 22) -> DataFrame:
    """a, b, kind, w, steps: 'entry' (step to handler's file), 'call' (file to file, within the step's code), 'ui' (screen to step), 'writes' (handler's file to data).

    steps: step, ui, writes (arrays); handled: step, handler. A step's code is what its handlers reach in `depth` calls, at most `most` nodes each;
    w counts calls or mentions, steps the distinct steps."""
    stash = Stash(spark)
    links = stash.put(edges.select("src", "dst").distinct())
    starts = handled.select(F.col("handler").alias("origin")).distinct()
    reached = graph.bounded(spark, links, starts, depth, most).select("origin", "node").unionByName(starts.select("origin", F.col("origin").alias("node")))
    code = stash.put(handled.join(reached, F.col("handler") == F.col("origin")).select("step", "node").distinct())
    entry = handled.select(F.col("step").alias("a"), paths.file_of("handler").alias("b"), F.lit("entry").alias("kind"), "step")
    ends = code.select(F.col("node").alias("src"), "step").join(links, "src").join(code.select(F.col("node").alias("dst"), "step"), ["dst", "step"])
    call = ends.select(paths.file_of("src").alias("a"), paths.file_of("dst").alias("b"), F.lit("call").alias("kind"), "step").filter("a <> b")
    ui = steps.select("step", F.explode("ui").alias("u")).select(paths.file_of("u").alias("a"), F.col("step").alias("b"), F.lit("ui").alias("kind"), "step")
    home = handled.groupBy("step").agg(F.min(paths.file_of("handler")).alias("home"))
    wrote = steps.select("step", F.explode("writes").alias("d")).dropna().join(home, "step", "left").select(F.coalesce("home", "step").alias("a"), F.substring_index("d", ".", 1).alias("b"), F.lit("writes").alias("kind"), "step")
    every = reduce(DataFrame.unionByName, [entry, call, ui, wrote])
    return every.groupBy("a", "b", "kind").agg(F.count(F.lit(1)).alias("w"), F.countDistinct("step").alias("steps"))


def depths(spark: SparkSession, made: DataFrame) -> DataFrame:
    """file, depth: how far each file lies from the handlers' files along calls."""
    call = made.filter("kind = 'call'").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return graph.layers(spark, call, made.filter("kind = 'entry'").select(F.col("b").alias("node"))).withColumnRenamed("node", "file")


def painted(cards: DataFrame, changed: DataFrame) -> DataFrame:
    """node, kind, card: the card that shows each changed symbol, null where none does.

    cards: card, path; changed: node, kind ('changed' or 'new'). A card of the very path comes first, then one whose path ends a symbol's, or
    begins where a symbol's ends, by whole parts; of several the first. Such paths have the same last part, which is what is joined on."""
    name = lambda c: F.substring_index(c, "/", -1)
    c = cards.select("card", F.col("path").alias("_path"), name("path").alias("_name"))
    s = changed.withColumn("path", paths.file_of("node")).withColumn("_name", name("path"))
    ends = lambda a, b: F.endswith(F.concat(F.lit("/"), F.col(a)), F.concat(F.lit("/"), F.col(b)))
    met = s.join(c, "_name").filter(ends("path", "_path") | ends("_path", "path"))
    first = met.groupBy("node", "kind").agg(F.min_by("card", F.struct(F.col("path") != F.col("_path"), F.col("card"))).alias("card"))
    return changed.select("node", "kind").distinct().join(first, ["node", "kind"], "left").select("node", "kind", "card")


def chapter_steps(chapters: DataFrame, code: DataFrame, by: list[str]) -> DataFrame:
    """by, chapter, step: the steps whose code holds a symbol of a chapter. chapters: by, chapter, node; code: by, step, node."""
    return chapters.join(code, [*by, "node"]).select(*by, "chapter", "step").distinct()
