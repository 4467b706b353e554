"""Passes of several mappers over one code area made into one map: flows by vote, steps by what is grouped together, evidence by agreement.

All areas are reconciled at once; `scope` names the area, and how many must agree follows from the number of its mappers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changegraph.functions import tidy
from changegraph.operators import consensus, graph
from changegraph.session import Stash


def needs(steps: DataFrame) -> DataFrame:
    """scope, runs, need."""
    n = steps.groupBy("scope").agg(F.countDistinct("run_id").alias("runs"))
    return n.select("scope", "runs", consensus.threshold(F.col("runs")).alias("need"))


def status(votes: Column, need: Column) -> Column:
    return F.when(votes >= need, "agreed").when(votes >= 2, "contested").otherwise("single-source")


def flows_of(placed: DataFrame, need: DataFrame, files: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """scope, endpoint, flow, votes, voters, tied, status of each endpoint that is placed.

    placed: scope, endpoint, run_id, flow_id, pos (each run's first placement). Of equally many votes the flow that the agreed entry points
    of the handler's file are in most, else the one voted first. files: endpoint, file. pins(endpoint, flow) are confirmed and skip the vote."""
    voted = placed.filter("flow_id is not null")
    if pins is not None:
        voted = voted.join(pins.select("endpoint"), "endpoint", "left_anti")
    counts = voted.groupBy("scope", "endpoint", "flow_id").agg(F.count(F.lit(1)).alias("v"), F.min("pos").alias("o"))
    first = F.min_by("flow_id", F.struct(-F.col("v"), F.col("o"), F.col("flow_id")))
    top = counts.groupBy("scope", "endpoint").agg(first.alias("top"), F.max("v").alias("votes"), F.sum("v").alias("voters"))
    top = Stash(placed.sparkSession).put(top.join(need, "scope").withColumn("status", status(F.col("votes"), F.col("need"))).select("scope", "endpoint", "top", "votes", "voters", "status"))
    agreed = top.filter("status = 'agreed'").select("endpoint", F.col("top").alias("flow_id"))
    if pins is not None:
        agreed = agreed.unionByName(pins.select("endpoint", F.col("flow").alias("flow_id")))
    affinity = agreed.join(files, "endpoint").groupBy("file", "flow_id").agg(F.count(F.lit(1)).alias("near"))
    best = counts.join(top.select("endpoint", "votes", "top"), "endpoint").filter("v = votes").join(files, "endpoint", "left").join(affinity, ["file", "flow_id"], "left")
    key = F.struct(-F.coalesce("near", F.lit(0)), F.when(F.col("flow_id") == F.col("top"), 0).otherwise(1), F.col("o"), F.col("flow_id"))
    chosen = best.groupBy("endpoint").agg(F.min_by("flow_id", key).alias("flow"), (F.count(F.lit(1)) > 1).alias("tied"))
    out = top.join(chosen, "endpoint").select("scope", "endpoint", "flow", "votes", "voters", "tied", "status")
    if pins is not None:
        pinned = placed.select("scope", "endpoint").distinct().join(pins, "endpoint").select("scope", "endpoint", "flow", F.lit(0).cast("bigint").alias("votes"), F.lit(0).cast("bigint").alias("voters"), F.lit(False).alias("tied"), F.lit("confirmed").alias("status"))
        out = out.unionByName(pinned)
    return out


def groups_of(spark: SparkSession, placed: DataFrame, flows: DataFrame, need: DataFrame) -> DataFrame:
    """endpoint, grp: entry points of one flow that enough steps hold together, directly or through others."""
    pairs = consensus.together(placed, "step_no", "endpoint")
    of = lambda x: flows.select(F.col("endpoint").alias(x), F.col("flow").alias(f"f{x}"), F.col("scope").alias(f"s{x}"))
    links = pairs.join(of("a"), "a").join(of("b"), "b").filter("fa = fb and sa = sb").join(need.withColumnRenamed("scope", "sa"), "sa").filter("n >= need")
    return graph.connected(spark, links.select(F.col("a").alias("src"), F.col("b").alias("dst")), flows.select(F.col("endpoint").alias("node"))).select(F.col("node").alias("endpoint"), F.col("component").alias("grp"))


def reconcile(spark: SparkSession, steps: DataFrame, files: DataFrame, tested: DataFrame | None = None, pins: DataFrame | None = None, confirmed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(flows of entry points, steps of the map).

    steps: scope, run_id, flow_id, pos, at (place in its flow, 0 to 1), step_no, id, step_name, actor, ui, code_path, writes and endpoint_list, the entry points
    tidied and named as in files(endpoint, file). tested(endpoint) and confirmed(step, `flow/id`) raise a step's evidence.

    Steps: scope, flow, grp, id, step_name, actor, endpoints, hops, disputed, files, exact, runs, evidence, position."""
    stash = Stash(spark)
    need = stash.put(needs(steps))
    cites = steps.select("scope", "run_id", "flow_id", "pos", "step_no", F.explode("endpoint_list").alias("endpoint"))
    cites = stash.put(cites)
    first = cites.groupBy("scope", "endpoint", "run_id").agg(F.min_by(F.struct("flow_id", "step_no", "pos"), "pos").alias("f"))
    placed = stash.put(first.select("scope", "endpoint", "run_id", "f.flow_id", "f.step_no", "f.pos"))
    flows = stash.put(flows_of(placed, need, files, pins))
    groups = stash.put(groups_of(spark, cites.select("step_no", "endpoint").distinct(), flows, need).join(flows, "endpoint"))

    # each mapper's step that overlaps a group most, the first of equal ones
    held = cites.select(F.struct("run_id", "pos", "step_no").alias("key"), "endpoint")
    met = consensus.overlaps(groups.select("grp", "endpoint"), held, "grp", "key", "endpoint")
    best = met.groupBy("grp", F.col("key.run_id").alias("run_id")).agg(F.min(F.struct((-F.col("jaccard")).alias("j"), F.col("key.pos").alias("pos"), F.col("key.step_no").alias("step_no"))).alias("b"))
    detail = steps.select("step_no", "at", "id", "step_name", "actor", "code_path")
    matched = stash.put(best.select("grp", "run_id", F.col("b.j").alias("j"), F.col("b.pos").alias("pos"), F.col("b.step_no").alias("step_no")).join(detail, "step_no"))

    some = groups.groupBy("grp").agg(F.first("scope").alias("scope"), F.min("flow").alias("flow"), F.array_sort(F.collect_set("endpoint")).alias("endpoints"), F.min(F.col("status") == "single-source").alias("all_single"), F.min(F.col("status").isin("agreed", "confirmed")).alias("all_agreed"))
    order = F.struct("j", "pos")
    seen = matched.groupBy("grp").agg(F.count(F.lit(1)).alias("matches"), F.count(F.when(F.col("j") == -1, 1)).alias("exact"), F.min_by("step_name", order).alias("step_name"), F.array_sort(F.collect_set("run_id")).alias("runs"), F.avg("at").alias("position"))
    ids = consensus.mode_first(matched.select("grp", "id", order.alias("o")), ["grp"], "id", "o")
    actors = consensus.mode_first(matched.select("grp", "actor", order.alias("o")), ["grp"], "actor", "o")

    # hops that two mappers see, or the only one does; each at its mean place
    n = F.greatest(F.size(F.coalesce("code_path", F.array().cast("array<string>"))), F.lit(1))
    hop = matched.select("grp", n.alias("n"), F.posexplode(tidy.nodes("code_path")).alias("i", "hop")).groupBy("grp", "hop").agg(F.count(F.lit(1)).alias("votes"), F.round(F.avg(F.col("i") / F.col("n")), 9).alias("place"))  # rounded, so that the order of a sum doesn't decide
    hop = hop.join(some.select("grp", "scope"), "grp").join(need.select("scope", F.col("runs").alias("mappers")), "scope")
    kept = (F.col("votes") >= 2) | (F.col("mappers") == 1)
    hops = hop.groupBy("grp").agg(F.sort_array(F.collect_list(F.when(kept, F.struct("place", "hop")))).alias("h"), F.array_sort(F.collect_list(F.when(~kept, F.col("hop")))).alias("disputed"))
    hops = hops.select("grp", F.col("h.hop").alias("hops"), "disputed")

    every = some.join(seen, "grp").join(ids, "grp", "left").join(actors, "grp", "left").join(hops, "grp", "left").join(need.select("scope", "need"), "scope")
    level = F.when(F.col("all_single"), "single-source").when((F.col("exact") >= F.col("need")) & F.col("all_agreed"), "agreed").when(F.col("exact") >= F.col("need"), "contested").when(F.col("matches") >= 2, "contested").otherwise("single-source")
    every = every.withColumn("evidence", level)
    if tested is not None:
        bare = groups.join(tested.select("endpoint"), "endpoint", "left_anti").select("grp").distinct().withColumn("bare", F.lit(True))
        every = every.join(bare, "grp", "left").withColumn("evidence", F.when((F.col("evidence") == "agreed") & F.col("bare").isNull(), "tested").otherwise(F.col("evidence"))).drop("bare")
    if confirmed is not None:
        by_hand = confirmed.select(F.col("step").alias("_step"), F.lit(True).alias("by_hand"))
        every = every.join(by_hand, F.concat_ws("/", "flow", "id") == F.col("_step"), "left").withColumn("evidence", F.when(F.col("by_hand"), "confirmed").otherwise(F.col("evidence")))
    nodes = F.coalesce("hops", F.array().cast("array<string>"))
    files_of = F.size(F.array_distinct(F.transform(nodes, lambda h: F.regexp_extract(h, r"^(.*):[^:]*$", 1))))
    return flows, every.select("scope", "flow", "grp", "id", "step_name", "actor", "endpoints", nodes.alias("hops"), F.coalesce("disputed", F.array().cast("array<string>")).alias("disputed"), files_of.alias("files"), "exact", "runs", "evidence", F.round("position", 6).alias("position"))
