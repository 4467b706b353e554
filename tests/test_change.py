from __future__ import annotations

import random
import subprocess
from collections import Counter

import pytest

from changegraph.operators import blind, change, reconcile
from changegraph.sources import git

APP = {
    "app/run.py": 'from app import core\n\ndef work():\n    return core.step()\n\nif __name__ == "__main__":\n    work()\n',
    "app/other.py": 'from app import core\n\nif __name__ == "__main__":\n    core.alone()\n',
    "app/core.py": 'LIMIT = 1\n\n\ndef step():\n    """Steps."""\n    return deep(1)\n\n\ndef deep(x):\n    return x\n\n\ndef alone():\n    return 2\n\n\ndef unused():\n    return 3\n',
    "app/__init__.py": "",
    "README.md": "x\n",
}
SPECS = [{"adapter": "cli", "commands": "app", "prog": "app"}]


@pytest.fixture
def analysed(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", tmp_path, "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    def commit(files, tag):
        for p, t in files.items():
            at = tmp_path / p
            at.parent.mkdir(parents=True, exist_ok=True)
            at.unlink() if t is None else at.write_text(t)
        run("add", "-A"), run("commit", "-qm", tag, "--allow-empty"), run("tag", tag)

    def analyse(edit):
        run("init", "-q")
        commit(APP, "base")
        commit(edit, "head")
        spark.dataSource.register(git.GitFiles)
        spark.dataSource.register(git.GitDiff)
        files = spark.read.format("gitfiles").option("repo", str(tmp_path)).option("refs", "base,head").load().cache()
        hunks = spark.read.format("gitdiff").option("repo", str(tmp_path)).option("base", "base").option("head", "head").load()
        steps = spark.createDataFrame([("f/run", "f", ["CLI app run"], ["app/run.py:work", "app/core.py:step"]), ("g/other", "g", ["CLI app other"], [])], "step string, flow string, endpoints array<string>, anchors array<string>")
        return change.analyse(spark, files, hunks, "base", "head", SPECS, steps)

    return analyse


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_body_edit_spreads(analysed):
    c = analysed({"app/core.py": APP["app/core.py"].replace("def deep(x):\n    return x", "def deep(x, y=1):\n    return x + y")})
    assert c.verdict == "spreads" and rows(c.symbols) == [("app/core.py:deep", "modified", False, True)]
    assert rows(c.reach) == [("app/core.py:deep", "CLI app run", "f")] and rows(c.hidden_steps) == [("f/run", "app/core.py:deep")]
    assert rows(c.touched_steps) == [] and rows(c.off_map) == [("app/core.py:deep",)] and rows(c.moved) == []


def test_docstring_edit_is_contained(analysed):
    c = analysed({"app/core.py": APP["app/core.py"].replace("Steps.", "Walks.")})
    assert c.verdict == "contained" and rows(c.symbols) == [("app/core.py:step", "modified", True, False)]


def test_unused_function_is_contained(analysed):
    assert analysed({"app/core.py": APP["app/core.py"].replace("return 3", "return 4"), "README.md": "y\n"}).verdict == "contained"


def test_new_call_moves_reach(analysed):
    c = analysed({"app/core.py": APP["app/core.py"].replace("return deep(1)", "return deep(1) + alone()")})
    assert rows(c.moved) == [("CLI app run", "app/core.py:alone", "gained")] and rows(c.touched_steps) == [("f/run", "app/core.py:step")]
    assert rows(c.spread) == [("CLI app run", "f")] and c.verdict == "spreads"


def test_blind_spots(analysed):
    c = analysed({"app/core.py": APP["app/core.py"].replace("LIMIT = 1", "LIMIT = 2"), "app/bad.py": "def (:\n", "app/migrations/one.py": "def m():\n    pass\n", "web/x.ts": "export function a() {}\n", "data.bin": "1\n", "app/other.py": "def f():\n    pass\n"})
    assert c.verdict == "blind"
    assert set(rows(c.blind)) == {("module-level change", "app/bad.py"), ("module-level change", "app/core.py"), ("changed file can't be parsed", "app/bad.py"), ("migration", "app/migrations/one.py"), ("code without call graph", "web/x.ts"), ("outside of the analysis", "data.bin")}
    assert rows(c.endpoints) == [("CLI app other", "removed"), ("CLI app run", "both")] and ("CLI app other", "g") in rows(c.spread)


def test_a_new_class_blinds_nobody_and_a_changed_one_does(analysed):
    fresh = APP["app/core.py"] + "\n\nclass Fresh:\n    size = 1\n"
    c = analysed({"app/core.py": fresh, "docs/a.png": "x", "LICENSE": "x", "web/doc/b.html": "x", "tests/test_core.py": "def test_a():\n    pass\n"})
    assert rows(c.blind) == [] and c.verdict == "contained"


def test_a_changed_class_without_reach(analysed):
    c = analysed({"app/run.py": APP["app/run.py"] + "\n\nclass Model:\n    size = 1\n"})
    assert c.verdict == "contained"
    blind.RULES  # the rule itself is tested on tables below


def test_rules_on_tables(spark):
    def t(schema, *rows):
        return spark.createDataFrame([("c", *r) for r in rows] + [("other", *r) for r in rows[:0]], f"change string, {schema}")

    files = t("path string, kind string, graphed boolean", ("a.py", "code", True), ("b.ts", "code", False), ("migrate/m.py", "code", True), ("tests/migrate/t.py", "test", True), ("x.bin", "outside", False), ("y.JPG", "outside", False), ("LICENSE", "outside", False), ("doc/z.html", "outside", False))
    symbols = t("path string, name string, status string", ("a.py", "<module>", "modified"), ("migrate/m.py", "<module>", "modified"), ("a.py", "Model", "modified"), ("a.py", "Model.save", "modified"), ("a.py", "Fresh", "new"), ("a.py", "Seen", "deleted"), ("a.py", "lower", "modified"))
    got = blind.blind_spots(["change"], files, t("path string", ("a.py",), ("other.py",), ("other.py",)), t("subject string", ("head",)), symbols, t("path string, name string", ("a.py", "Seen")), t("endpoint string, handler string", ("E", "a.py:lower"), ("F", "a.py:gone"), ("G", "a.py:lower")), t("endpoint string, handler string", ("G", "a.py:lower")), t("node string", ("a.py:lower",)))
    assert rows(got) == sorted(("c", r, s) for r, s in zip(blind.RULES, ("a.py", "other.py", "head", "migrate/m.py", "a.py", "a.py:Model", "b.ts", "x.bin", "E")))


def test_settings_of_an_analysis(analysed, monkeypatch):
    from changegraph.sources.config import Settings

    asked = change.analyse
    monkeypatch.setattr(change, "analyse", lambda *a: asked(*a, settings=Settings(graph_roots=["app"], app_dirs=["app"], out="out/map")))
    c = analysed({"web/run.py": "LIMIT = 1\n", "out/map/x.json": "{}", "app/web.ts": "const a = 1\n"})
    assert rows(c.blind) == [("code without call graph", "app/web.ts"), ("outside of the analysis", "web/run.py")]


def test_an_inventory_that_fails_is_a_blind_spot(analysed, monkeypatch):
    monkeypatch.setitem(change.scan.__globals__["ADAPTERS"], "cli", lambda *a: (_ for _ in ()).throw(ValueError("no")))
    c = analysed({"README.md": "z\n"})
    assert rows(c.blind) == [("inventory failed", "base: ValueError"), ("inventory failed", "head: ValueError")]


def test_reconciled_like_by_hand(spark):
    rnd = random.Random(9)
    ends, runs = [f"E{i}" for i in range(8)], ["r1", "r2", "r3", "r4"]
    steps, n = [], 0
    for k, r in enumerate(runs):
        for f in range(2):
            for s in range(2):
                base = ends[f * 4 + s * 2 : f * 4 + s * 2 + 2]
                own = [e for e in base if rnd.random() < 0.9]
                n += 1
                steps.append(("a", r, f"f{f if rnd.random() < 0.9 else 1 - f}", (k, f, s), s / 2, n, f"s{s}", f"name {s}", "user", None, [f"x.py:h{s}", None, f"x.py:h{s}", f"y.py:z{k}"], [], own))
    schema = "scope string, run_id string, flow_id string, pos struct<p: int, f: int, s: int>, at double, step_no int, id string, step_name string, actor string, ui array<string>, code_path array<string>, writes array<string>, endpoint_list array<string>"
    files = spark.createDataFrame([(e, "h.py") for e in ends], "endpoint string, file string")
    flows, made = reconcile.reconcile(spark, spark.createDataFrame(steps, schema), files, spark.createDataFrame([(e,) for e in ends], "endpoint string"))
    votes: dict = {}
    for st in steps:
        for e in st[12]:
            votes.setdefault(e, {}).setdefault(st[1], st[2])
    got = {r["endpoint"]: r for r in flows.collect()}
    assert set(got) == set(votes)
    for e, v in votes.items():
        c = Counter(v.values())
        top = max(c.values())
        assert got[e]["votes"] == top and got[e]["voters"] == len(v)
        assert got[e]["status"] == ("agreed" if top >= 3 else "contested" if top >= 2 else "single-source")
        assert got[e]["flow"] in [f for f, n in c.items() if n == top]
    together = Counter((a, b) for st in steps for a in set(st[12]) for b in set(st[12]) if a < b)
    label = {e: e for e in votes}
    for _ in ends:
        for (a, b), n in together.items():
            if n >= 3 and got[a]["flow"] == got[b]["flow"]:
                label[a] = label[b] = min(label[a], label[b])
    rows_ = {tuple(r["endpoints"]): r for r in made.collect()}
    assert set(rows_) == {tuple(sorted(e for e in label if label[e] == x)) for x in set(label.values())}
    for g, r in rows_.items():
        exact = sum(any(set(st[12]) == set(g) for st in steps if st[1] == run) for run in runs)
        assert r["exact"] == exact and r["evidence"] in ("tested", "agreed", "contested", "single-source")
        assert (r["evidence"] == "tested") == (exact >= 3 and all(got[e]["status"] == "agreed" for e in g))
        assert all(h.startswith("x.py") for h in r["hops"]) and all(h.startswith("y.py") for h in r["disputed"])
