"""The engine on one repository: python -m changegraph COMMAND --repo PATH ...

inventory [REF]        entry points as JSON
graph [REF]            definitions and calls as JSON
change BASE [HEAD]     what a change does: report, or facts with --json
reconcile PASS...      mapping passes to a map (--out DIR writes map.json, map.md, questions.md)
verify PASS...         what passes cite and isn't there
link FACTS             a file of facts as a link's fragment

REF is a revision, or WORKTREE for the files as they lie on disk. Settings come from changegraph.toml in the repository, see sources/config.py.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegraph.adapters import scan
from changegraph.functions import codec, render, tidy
from changegraph.functions.paths import CODE_SUFFIXES, file_of, symbol_of
from changegraph.operators import change, reconcile, tested
from changegraph.parse import graph_of
from changegraph.session import Stash, local_session
from changegraph.sources import artifacts, config, git

NO_STEPS = "step string, flow string, endpoints array<string>, anchors array<string>"


def files_at(spark: SparkSession, repo: str, refs: list[str]) -> DataFrame:
    """ref, path, text of all files that are code."""
    spark.dataSource.register(git.GitFiles)
    suffixes = ",".join(f".{x}" for x in (*CODE_SUFFIXES, "txt"))
    return Stash(spark).put(spark.read.format("gitfiles").option("repo", repo).option("refs", ",".join(refs)).option("suffixes", suffixes).load())


def settings_of(repo: str, ref: str) -> config.Settings:
    tree = (git.on_disk if ref == git.WORKTREE else git.listed)(repo, ref, [], ("",))
    return config.load(Path(repo) / "changegraph.toml", tree)


def entries_at(files: DataFrame, settings: config.Settings) -> DataFrame:
    defs = graph_of.definitions(files, graph_of.python_facts(files))
    return scan(settings.entries, files, defs)[0] if settings.entries else files.sparkSession.createDataFrame([], "ref string, endpoint string, handler string, line int, aliases array<string>, implicit string")


def passes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The steps of passes as `reconcile` takes them, scope '' for all: one map comes out."""
    raw = artifacts.read(spark, paths, artifacts.PASS).withColumn("run_id", F.coalesce("run_id", "file"))
    flow = raw.select("run_id", F.posexplode("flows").alias("flow_pos", "f"))
    n = F.greatest(F.size("f.steps"), F.lit(1))
    step = flow.select("run_id", "flow_pos", F.col("f.id").alias("flow_id"), n.alias("n"), F.posexplode("f.steps").alias("step_pos", "s"))
    nodes = lambda c: tidy.nodes(f"s.{c}").alias(c)
    return step.select(
        F.lit("").alias("scope"), "run_id", "flow_id", F.struct("run_id", "flow_pos", "step_pos").alias("pos"), (F.col("step_pos") / F.col("n")).alias("at"), F.xxhash64("run_id", "flow_pos", "step_pos").alias("step_no"),
        "s.id", F.col("s.name").alias("step_name"), "s.actor", nodes("ui"), nodes("code_path"), "s.writes", tidy.entries("s.endpoints").alias("endpoint_list"),
    )


def map_steps(spark: SparkSession, path: Path) -> DataFrame:
    """The steps of a map's JSON for the analysis of a change; none without a map."""
    if not path.exists():
        return spark.createDataFrame([], NO_STEPS)
    m = artifacts.read(spark, str(path), artifacts.MAP).select(F.explode("flows").alias("f")).select(F.col("f.id").alias("flow"), F.explode("f.steps").alias("s"))
    return m.select(F.concat_ws("/", "flow", "s.id").alias("step"), "flow", tidy.entries("s.endpoints").alias("endpoints"), F.array_union(tidy.nodes("s.code_path"), tidy.nodes("s.ui")).alias("anchors"))


def facts_of(c: change.Change, base: str, head: str) -> dict:
    """A change's tables as one record; they are as large as the change and what it reaches."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    symbols, moved = rows(c.symbols), rows(c.moved)
    return {
        "base": base,
        "head": head,
        "verdict": c.verdict,
        "blind": [f"{r['rule']}: {r['subject']}" for r in sorted(rows(c.blind), key=lambda r: (r["rule"], r["subject"]))],
        "symbols": sorted(symbols, key=lambda r: r["node"]),
        "endpoints": {s: sorted(r["endpoint"] for r in rows(c.endpoints) if r["status"] == s) for s in ("added", "removed", "moved")},
        "touched": sorted({r["step"] for r in rows(c.touched_steps)}),
        "hidden": sorted({r["step"] for r in rows(c.hidden_steps)}),
        "off_map": sorted(r["node"] for r in rows(c.off_map)),
        "gained": sorted(f"{r['endpoint']} reaches {r['node']}" for r in moved if r["moved"] == "gained"),
        "lost": sorted(f"{r['endpoint']} reached {r['node']}" for r in moved if r["moved"] == "lost"),
        "spreads_to": sorted({r["endpoint"] for r in rows(c.spread)}),
        "flows": sorted({r["flow"] for r in rows(c.spread)}),
    }


def run_change(spark: SparkSession, a: argparse.Namespace) -> str:
    base, head = a.args[0], a.args[1] if len(a.args) > 1 else "HEAD"
    settings = settings_of(a.repo, head)
    spark.dataSource.register(git.GitDiff)
    hunks = spark.read.format("gitdiff").option("repo", a.repo).option("base", base).option("head", head).load()
    steps = map_steps(spark, Path(a.repo) / settings.out / "map.json")
    facts = facts_of(change.analyse(spark, files_at(spark, a.repo, [base, head]), hunks, base, head, settings.entries, steps, settings), base, head)
    return json.dumps(facts, indent=1) if a.json else render.lens_markdown(facts)


def run_reconcile(spark: SparkSession, a: argparse.Namespace) -> str:
    settings = settings_of(a.repo, a.ref)
    files = files_at(spark, a.repo, [a.ref])
    entries = Stash(spark).put(entries_at(files, settings))
    steps = Stash(spark).put(passes(spark, a.args).withColumn("flow_id", settings.adopt(F.col("flow_id"))))
    texts = files.filter(F.col("path").rlike("|".join(f"^{t.strip('/')}/" for t in a.tests.split(",")))).select(F.lit("").alias("by"), "text") if a.tests else None
    hit = tested.tested(entries.select(F.lit("").alias("by"), "endpoint", "handler", "aliases"), texts, ["by"]).select("endpoint") if texts is not None else None
    flows, made = reconcile.reconcile(spark, steps, entries.select("endpoint", file_of("handler").alias("file")), hit)
    runs = steps.groupBy("scope").agg(F.array_sort(F.collect_set("run_id")).alias("runs")).join(reconcile.needs(steps).select("scope", "need"), "scope")
    told = artifacts.read(spark, a.args, artifacts.PASS).select(F.explode("flows").alias("f")).filter(F.trim("f.summary") != "").groupBy(settings.adopt(F.col("f.id")).alias("flow")).agg(F.min("f.summary").alias("summary"))
    text = artifacts.map_json(told.select(F.lit("").alias("scope"), "flow", "summary"), made, runs, settings.flow_place(F.col("flow"))).first()["json"]
    if a.out:
        out = Path(a.out)
        out.mkdir(parents=True, exist_ok=True)
        whole = json.loads(text)
        (out / "map.json").write_text(json.dumps(whole, indent=1))
        (out / "map.md").write_text(render.map_markdown([{**f, "steps": [{**s, "step_name": s.get("name")} for s in f["steps"]]} for f in whole["flows"]]))
        named = lambda cond: [{"endpoint": r["endpoint"], "flows": [r["flow"]]} for r in flows.filter(cond).collect()]
        unplaced = [r[0] for r in entries.select("endpoint").join(flows.select("endpoint"), "endpoint", "left_anti").collect()]
        busy = [{"step": f"{r['flow']}/{r['id']}", "hops": r["n"]} for r in made.select("flow", "id", F.size("hops").alias("n")).filter("n >= 8").collect()]
        notes = [r[0] for r in artifacts.read(spark, a.args, artifacts.PASS).select(F.explode("observations")).dropna().distinct().collect()]
        (out / "questions.md").write_text(render.questions_markdown(named("tied"), unplaced, busy, contested=named("status = 'contested'"), observations=notes))
    return text


def run_verify(spark: SparkSession, a: argparse.Namespace) -> str:
    files = files_at(spark, a.repo, [a.ref])
    known = entries_at(files, settings_of(a.repo, a.ref)).select(F.lit("").alias("by"), "endpoint", "aliases")
    every = Stash(spark).put(known.select("by", F.explode(F.concat(F.array("endpoint"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("endpoint")).distinct())
    steps = Stash(spark).put(passes(spark, a.args))
    place = F.concat_ws("/", "flow_id", "id").alias("place")
    cites = steps.select(F.lit("").alias("by"), place, F.explode("endpoint_list").alias("endpoint"))
    anchors = steps.select(F.lit("").alias("by"), place, F.explode(F.array_union("code_path", "ui")).alias("anchor"))
    defs = graph_of.definitions(files, graph_of.python_facts(files)).select(F.lit("").alias("by"), file_of("node").alias("file"), symbol_of("node").alias("sym"))
    found = tested.problems(cites, anchors, every, files.select(F.lit("").alias("by"), F.col("path").alias("file")), defs, ["by"])
    told = artifacts.read(spark, a.args, artifacts.PASS).select(F.lit("").alias("by"), F.explode(tidy.entries(F.transform("unplaced_endpoints", lambda u: u["endpoint"]))).alias("endpoint"))
    left = tested.missing(known, cites, told, ["by"])
    lines = [f"{r['place']}: {r['problem']} {r['subject']}" for r in found.collect()] + [f"not placed: {r['endpoint']}" for r in left.collect()]
    return "\n".join(sorted(lines)) or "sound"


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="changegraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=("inventory", "graph", "change", "reconcile", "verify", "link"))
    p.add_argument("args", nargs="*")
    p.add_argument("--repo", default=None)
    p.add_argument("--ref", default=git.WORKTREE)
    p.add_argument("--out", default=None)
    p.add_argument("--tests", default="", help="directories of tests, with commas between")
    p.add_argument("--json", action="store_true")
    p.add_argument("--cpus", type=int, default=4)
    a = p.parse_args(argv)
    a.repo = a.repo or git.toplevel()
    if a.command == "link":
        text = Path(a.args[0]).read_text()
        fragment = codec.fitted_text(text)
        print(fragment or "too large for a link")
        return int(fragment is None)
    spark = SparkSession.getActiveSession() or local_session(a.cpus)
    spark.sparkContext.setLogLevel("ERROR")
    if a.command in ("inventory", "graph"):
        ref = a.args[0] if a.args else a.ref
        files = files_at(spark, a.repo, [ref])
        settings = settings_of(a.repo, ref)
        if a.command == "inventory":
            row = artifacts.inventory_json(entries_at(files, settings), ["ref"]).first()
            out = row["json"] if row else '{"endpoints":[]}'
        else:
            defs, edges, _ = graph_of.build(settings.graphed_files(files))
            row = artifacts.graph_json(defs, edges, ["ref"]).first()
            out = row["json"] if row else '{"defs":{},"edges":[]}'
    else:
        out = {"change": run_change, "reconcile": run_reconcile, "verify": run_verify}[a.command](spark, a)
    print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
