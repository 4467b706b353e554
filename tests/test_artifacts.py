from __future__ import annotations

import json
import sqlite3
import subprocess

import pytest
from pyspark.sql import functions as F

from changegraph.functions import names, paths, render
from changegraph.operators import tested
from changegraph.parse import graph_of
from changegraph.sources import artifacts, git, index, results
from changegraph.sources.config import Settings


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_inventories_round_trip(spark):
    e = spark.createDataFrame([("r", "GET /b", "x.py:b", 3, ["b_path"], None), ("r", "CLI a", None, None, [], "mounted"), ("s", "GET /a", "y.py:a", 1, None, None)], "repo string, endpoint string, handler string, line int, aliases array<string>, implicit string")
    j = {r["repo"]: r["json"] for r in artifacts.inventory_json(e, ["repo"]).collect()}
    assert [x["endpoint"] for x in json.loads(j["r"])["endpoints"]] == ["GET /b", "CLI a"] and json.loads(j["r"])["endpoints"][0]["aliases"] == ["b_path"]
    assert artifacts.inventory_json(e, ["repo"]).filter("repo = 'r'").select(artifacts.kinds_of("json")).first()[0] == {"CLI": 1, "GET": 1}


def test_graphs_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("r", "b", 5, 9), ("r", "a", 1, 4)], "repo string, node string, start int, end int")
    e = spark.createDataFrame([("r", "b", "a"), ("r", "a", "b"), ("r", "a", "b")], "repo string, src string, dst string")
    text = artifacts.graph_json(d, e, ["repo"]).first()["json"]
    assert json.loads(text) == {"defs": {"a": [1, 4], "b": [5, 9]}, "edges": [["a", "b"], ["b", "a"]]}
    (tmp_path / "g.json").write_text(json.dumps(json.loads(text), indent=1))
    defs, edges = artifacts.read_graph(spark, str(tmp_path))
    assert rows(defs.drop("file")) == [("a", 1, 4), ("b", 5, 9)] and rows(edges.drop("file")) == [("a", "b"), ("b", "a")]


def test_maps_and_passes(spark, tmp_path):
    steps = spark.createDataFrame([("s", "f", "two", "n2", "user", ["E2"], ["x.py:a"], [], 1, ["r1"], "agreed", 0.5), ("s", "f", "one", "n1", None, ["E1"], None, ["y.py:b"], 0, ["r1", "r2"], "contested", 0.0), ("s", "a", "z", None, None, [], [], [], 0, [], "single-source", 0.0)], "scope string, flow string, id string, step_name string, actor string, endpoints array<string>, hops array<string>, disputed array<string>, files int, runs array<string>, evidence string, position double")
    flows = spark.createDataFrame([("s", "f", "sum")], "scope string, flow string, summary string")
    runs = spark.createDataFrame([("s", ["r1", "r2"], 2)], "scope string, runs array<string>, need int")
    settings = Settings(vocabulary=[{"id": "f"}])
    m = json.loads(artifacts.map_json(flows, steps, runs, settings.flow_place(F.col("flow"))).first()["json"])
    assert [f["id"] for f in m["flows"]] == ["f", "a"] and [s["id"] for s in m["flows"][0]["steps"]] == ["one", "two"]
    assert m["agree_threshold"] == 2 and m["flows"][0]["steps"][1]["busyness"] == {"hops": 1, "files": 1}
    (tmp_path / "map.json").write_text(json.dumps(m, indent=1))
    back = artifacts.read(spark, str(tmp_path), artifacts.MAP).first()
    assert back["file"] == "map.json" and back["flows"][0]["steps"][0]["name"] == "n1"


def test_facts_and_pages(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b": null}], "hunks": [1], "c": "x"}'), (2, "[1]"), (3, "no"), (4, None)], "n int, t string")
    got = {r["n"]: json.loads(r["json"]) for r in artifacts.facts_json(df, "n", "t").collect()}
    assert got == {1: {"a": [1, {"b": None}], "c": "x"}}
    page = render.page({"x": "</script>", "y": 1})
    df = spark.createDataFrame([(page,), ("<p>",), (None,)], "h string")
    found = [r[0] for r in df.select(artifacts.embedded("h")).collect()]
    assert json.loads(found[0]) == {"x": "</script>", "y": 1} and found[1:] == [None, None]


def test_an_index_in_sqlite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "index.db")
    db.execute("CREATE TABLE nodes (id TEXT, kind TEXT, name TEXT, qualified_name TEXT, file_path TEXT, start_line INT, end_line INT, signature TEXT, docstring TEXT)")
    db.execute("CREATE TABLE edges (source TEXT, target TEXT, kind TEXT)")
    db.execute("CREATE TABLE files (path TEXT, errors TEXT)")
    nodes = [("1", "class", "A", "A", "a.ts", 1, 9, None, "First.\n\nMore."), ("2", "method", "constructor", "A::constructor", "a.ts", 2, 3, "(x: number)", None), ("3", "function", "go", "go", "a.ts", 10, 12, "go()", " "), ("4", "variable", "v", "v", "a.ts", 13, 13, None, None), ("5", "class", "B", "M::B", "b.rb", 1, 2, None, None)]
    db.executemany("INSERT INTO nodes VALUES (?,?,?,?,?,?,?,?,?)", nodes)
    db.executemany("INSERT INTO edges VALUES (?,?,?)", [("3", "1", "instantiates"), ("1", "2", "contains"), ("1", "3", "contains"), ("3", "4", "calls"), ("3", "3", "calls"), ("5", "1", "extends"), ("3", "5", "references")])
    db.executemany("INSERT INTO files VALUES (?,?)", [("a.ts", "[]"), ("b.rb", '["odd"]'), ("c.ts", None)])
    db.commit()
    n, e, f = index.read_sqlite(spark, str(tmp_path / "index.db"))
    assert rows(index.calls(n, e)) == [("a.ts:A", "a.ts:A.constructor"), ("a.ts:go", "a.ts:A"), ("a.ts:go", "b.rb:M.B")]
    assert rows(index.bases(n, e)) == [("b.rb:M.B", "A")]
    d = {r["node"]: (r["signature"], r["doc"]) for r in index.definitions(n).collect()}
    assert d == {"a.ts:A": (None, "First."), "a.ts:A.constructor": ("x: number", None), "a.ts:go": ("go()", None), "b.rb:M.B": (None, None)}
    files = spark.createDataFrame([("r", "a.ts", "class A {}\n"), ("r", "d.ts", "const q = 1\n"), ("r", "e.py", "def f():\n    pass\n")], "ref string, path string, text string")
    defs, edges, bad = graph_of.build(files, index=index.index_of("r", n, e, f))
    assert {r["node"] for r in defs.collect()} == {*d, "d.ts:q", "e.py:f"} and rows(edges.select("src", "dst"))[0] == ("a.ts:A", "a.ts:A.constructor") and rows(bad) == [("r", "b.rb")]


def test_git_in_one_process_and_on_disk(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", tmp_path, "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    run("init", "-q")
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b/é.py").write_text("x\n\ny")
    (tmp_path / "empty.py").write_text("")
    run("add", "."), run("commit", "-qm", "one"), run("tag", "v1")
    (tmp_path / "new.py").write_text("z")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/no.py").write_text("n")
    for source in (git.GitFiles, git.GitCommits):
        spark.dataSource.register(source)
    read = lambda ref: rows(spark.read.format("gitfiles").option("repo", str(tmp_path)).option("refs", ref).option("suffixes", ".py").load())
    assert read("v1") == [("v1", "a b/é.py", "x\n\ny"), ("v1", "empty.py", "")]
    assert read("WORKTREE") == [("WORKTREE", "a b/é.py", "x\n\ny"), ("WORKTREE", "empty.py", ""), ("WORKTREE", "new.py", "z")]
    c = spark.read.format("gitcommits").option("repo", str(tmp_path)).option("refs", "v1").load().first()
    assert c["sha"].startswith(c["short"]) and c["subject"] == "one" and c["remote"] is None
    assert git.toplevel(str(tmp_path / "a b")) == str(tmp_path)


def test_tested_entry_points(spark):
    e = [("GET /a/{id}/b", None, None), ("GET /a", None, None), ("POST /{x}/y", None, None), ("CLI tool run-it", "cmd/runner.py:__main__", None), ("CLI tool", "t.py:__main__", None), ("ACTION web/x.ts#save", None, None), ("TOOL find it", None, None), ("JOB j", None, ["job_path", "the job"]), ("JOB k", None, None)]
    entries = spark.createDataFrame([("r", *x) for x in e], "repo string, endpoint string, handler string, aliases array<string>")

    def hits(text, repo="r"):
        got = tested.tested(entries, spark.createDataFrame([(repo, text)], "repo string, text string"), ["repo"])
        return {r["endpoint"] for r in got.collect()}

    assert hits("get('/v1/a/7/b?x=1')") == {"GET /a/{id}/b"} and hits("get('/a/7/bc')") == set() and hits("get('/a/7/b/c')") == set()
    assert hits('see "/a-x"') == {"GET /a"} and hits("/a_x /ab") == set() and hits("/q/y.") == {"POST /{x}/y"}
    assert hits("import runner") == hits("runner.py") == hits("x 'run-it'") == {"CLI tool run-it"} and hits("run-it") == set()
    assert hits("don't save() it's") == {"ACTION web/x.ts#save"} and hits("saved") == set()
    assert hits('"find it"') == {"TOOL find it"} and hits("find it") == set()
    assert hits("job_path") == {"JOB j"} and hits("`the job`") == {"JOB j"} and hits("the job") == set()
    assert hits("import runner", "other") == set()


def test_names_and_results(spark, tmp_path):
    df = spark.createDataFrame([("new:read-A-meter", "web/pages/x.tsx:X", "user_accounts.name", "  class A:")], "f string, u string, w string, l string")
    assert tuple(df.select(names.flow_title("f"), names.screen_group("u"), names.data_label("w"), names.opens_class("l")).first()) == ("Read a meter", "pages", "User accounts", True)
    assert df.select(paths.shortened("u", ["web", "web/pages/", "."])).first()[0] == "x.tsx:X"
    (tmp_path / "t.json").write_text(json.dumps({"endpoints": {"GET /a": ["f", "g"]}, "tests": {"t1": {"endpoints": ["GET /a"], "symbols": ["f"]}, "t2": {"endpoints": [], "symbols": []}}}))
    ran, tests = results.runtime_reach(spark, str(tmp_path / "t.json"))
    assert rows(ran) == [("GET /a", "f"), ("GET /a", "g")] and ("t1", "GET /a", "f") in rows(tests)
    v, c = spark.createDataFrame([("1", ["GET /a", "GET /b"])], "id string, spreads_to array<string>"), spark.createDataFrame([("1", "g")], "id string, symbol string")
    assert rows(results.over_reported(v, c, ran)) == [("1", "GET /b")]


def test_pages():
    text = render.questions_markdown([{"endpoint": "GET /a: b", "flows": ["y", "x"]}], ["E"], [], observations=["o"])
    assert render.read_ties(text) == {"GET /a: b": ["x", "y"]} and "## Observations" in text
    with pytest.raises(ValueError, match="not filled"):
        render.brief("{{a}} {{b}}", {"a": "1"})
    assert "Content-Security-Policy" in render.locked("<html><head></head></html>")
    assert "1 of 2" in render.results_markdown({"right": 1, "changes": 2, "quiet": 0, "breaking": 1, "recalled": 1, "affected": 3, "flagged": 4}, [{"id": "a", "expected": "blind", "verdict": None, "affected": 1, "recalled": 0}])
    page = render.system_page([{"component": c, "flow": f, "steps": 1} for c in "abcdefgh" for f in ("x", "y")])
    assert page.count("-->") == 12 and "+2 more components" in page
    assert render.flow_page({"id": "f", "steps": [{"id": "a", "step_name": "A", "endpoints": ["E"]}, {"id": "b"}]}).count("-->") == 1
    assert "+3 more nodes" in render.step_page("s", [("a", "b")], 3)


def test_settings(spark):
    s = Settings(split=["app/big"], plumbing=["log", "lib/db.py", "vendor"], vocabulary=[{"id": "a", "proposed": ["new:x", "new:y"]}, {"id": "b"}], app_dirs=["app"], graph_roots=["app"])
    df = spark.createDataFrame([(x,) for x in ("app/big/one/f.py:g", "app/small/one/f.py:g", "lib/db.py:q", "lib/x.py:log", "vendor/z.py:z", "top.py:t")], "n string")
    assert [tuple(r) for r in df.select(s.component(F.col("n")), s.is_plumbing(F.col("n"))).collect()] == [("app/big/one", False), ("app/small", False), ("lib", True), ("lib", True), ("vendor", True), ("top.py", False)]
    flows = spark.createDataFrame([("new:y",), ("b",), ("c",)], "f string")
    assert [tuple(r) for r in flows.select(s.adopt(F.col("f")), s.flow_place(F.col("f"))).collect()] == [("a", 2), ("b", 1), ("c", 2)]
    tree = spark.createDataFrame([(x,) for x in ("app/a.py", "app/node_modules/b.py", "other/c.py", "app/docs/d.md")], "path string")
    assert [r[0] for r in s.graphed_files(tree).collect()] == ["app/a.py", "app/docs/d.md"]
    assert [r[0] for r in tree.select(s.kind(F.col("path"))).collect()] == ["code", "code", "outside", "doc"]


def test_commands_on_a_repository(spark, tmp_path, capsys):
    from changegraph.__main__ import main

    def run(*args):
        subprocess.run(["git", "-C", tmp_path, "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    def said(*args):
        assert main([*args, "--repo", str(tmp_path)]) == 0
        return capsys.readouterr().out.strip()

    (tmp_path / "app").mkdir()
    (tmp_path / "tests").mkdir()
    (tmp_path / "app/__init__.py").write_text("")
    (tmp_path / "app/go.py").write_text('from app import core\n\n\ndef main():\n    core.step(1)\n\n\nif __name__ == "__main__":\n    main()\n')
    (tmp_path / "app/core.py").write_text("def step(x):\n    return x\n")
    (tmp_path / "tests/test_go.py").write_text("from app import go\nimport go\n")
    (tmp_path / "changegraph.toml").write_text('out = "docs/map"\n[[entry]]\nadapter = "cli"\ncommands = "app"\nprog = "app"\n[graph]\nroots = ["app"]\n[app]\ndirs = ["app"]\n[[flow]]\nid = "run"\nproposed = "new:go"\n')
    run("init", "-q"), run("add", "."), run("commit", "-qm", "1"), run("tag", "base")
    assert json.loads(said("inventory"))["endpoints"] == [{"endpoint": "CLI app go", "handler": "app/go.py:__main__", "line": 8, "aliases": []}]
    assert ["app/go.py:main", "app/core.py:step"] in json.loads(said("graph", "base"))["edges"]
    step = {"id": "s", "name": "Go", "actor": "user", "endpoints": ["CLI app go"], "code_path": ["app/go.py:main", "app/core.py:gone"]}
    (tmp_path / "docs/map/runs").mkdir(parents=True)
    for k, flow in (("1", "new:go"), ("2", "run")):
        (tmp_path / f"docs/map/runs/{k}.json").write_text(json.dumps({"run_id": k, "flows": [{"id": flow, "summary": "Runs.", "steps": [step]}], "observations": ["odd"]}))
    runs = [str(tmp_path / "docs/map/runs/1.json"), str(tmp_path / "docs/map/runs/2.json")]
    assert said("verify", *runs) == "new:go/s: symbol not defined app/core.py:gone\nrun/s: symbol not defined app/core.py:gone"
    m = json.loads(said("reconcile", *runs, "--out", str(tmp_path / "docs/map"), "--tests", "tests"))
    assert [(f["id"], f["summary"], [(s["id"], s["evidence"]) for s in f["steps"]]) for f in m["flows"]] == [("run", "Runs.", [("s", "tested")])]
    assert "odd" in (tmp_path / "docs/map/questions.md").read_text() and "Go" in (tmp_path / "docs/map/map.md").read_text()
    (tmp_path / "app/core.py").write_text("def step(x, y=0):\n    return x + y\n")
    run("add", "."), run("commit", "-qm", "2")
    facts = json.loads(said("change", "base", "HEAD", "--json"))
    assert facts["verdict"] == "spreads" and facts["spreads_to"] == ["CLI app go"] and facts["hidden"] == ["run/s"] and facts["blind"] == []
    assert facts["symbols"] == [{"node": "app/core.py:step", "status": "modified", "cosmetic": False, "contract": True}]
    assert said("change", "base").startswith("# spreads")
    (tmp_path / "facts.json").write_text(json.dumps(facts))
    assert said("link", str(tmp_path / "facts.json")).startswith("#v1.")
