from __future__ import annotations

import json

from changegraph.operators import canvas, story
from changegraph.sources import config, results


def test_lint_and_left_out(spark):
    chapters = [("One", ["a.py:f", "a.py:no"], ["a.py", "no.py"], [("ran", ""), ("guessed", "x"), ("test", "t.py:T.test_f"), ("test", "t.py:T.gone"), ("test", "u.py")])]
    gone = [("was", "f/s", "f/s"), ("was", "a.py", None), ("was", "a.py:5", None), ("was", "a.py:50-60", None), ("was", "", "f/x"), ("was", "b.py:1", "")]
    stories = spark.createDataFrame([(1, chapters, gone), (2, [], gone), (3, None, None)], story.STORY)
    sym = spark.createDataFrame([(1, "a.py:f"), (1, "a.py:g"), (2, "z")], "change_no long, id string")
    files = spark.createDataFrame([(1, "a.py", "code"), (1, "r.md", "doc")], "change_no long, path string, kind string")
    steps = spark.createDataFrame([(1, "f/s")], "change_no long, key string")
    shown = spark.createDataFrame([(1, "a.py", 3, 6)], "change_no long, path string, first int, last int")
    texts = spark.createDataFrame([(1, "t.py", "def test_f(): pass")], "change_no long, path string, text string")
    got = sorted((r["code"], r["subject"], r["problem"]) for r in story.lint(stories, sym, files.drop("kind"), steps, shown, texts).collect())
    assert got == sorted(
        [
            ("story/symbol-not-changed", "chapters[0].symbols", "a.py:no"),
            ("story/file-not-changed", "chapters[0].files", "no.py"),
            ("story/cite-not-in-diff", "no_longer[3].cite", "a.py:50-60"),
            ("story/cite-not-in-diff", "no_longer[4].cite", ""),
            ("story/cite-not-in-diff", "no_longer[5].cite", "b.py:1"),
            ("story/step-not-on-map", "no_longer[4].step", "f/x"),
            ("story/verified-how", "chapters[0].verified[1].how", "guessed"),
            ("story/test-not-at-head", "chapters[0].verified[3].what", "t.py:T.gone"),
            ("story/test-not-at-head", "chapters[0].verified[4].what", "u.py"),
        ]
    )
    assert sorted(map(tuple, story.left_out(stories, sym, files).collect())) == [(1, "outside", "r.md"), (1, "unassigned", "a.py:g")]


def test_wires(spark):
    steps = spark.createDataFrame([("s1", ["w.tsx:A"], ["Crew.x", None]), ("s2", None, ["Crew.y"])], "step string, ui array<string>, writes array<string>")
    handled = spark.createDataFrame([("s1", "a.py:h")], "step string, handler string")
    edges = spark.createDataFrame([("a.py:h", "b.py:x"), ("a.py:h", "b.py:y"), ("b.py:x", "b.py:y"), ("b.py:y", "c.py:z")], "src string, dst string")
    made = canvas.wires(spark, steps, handled, edges).cache()
    assert sorted(map(tuple, made.collect())) == [("a.py", "Crew", "writes", 1, 1), ("a.py", "b.py", "call", 2, 1), ("b.py", "c.py", "call", 1, 1), ("s1", "a.py", "entry", 1, 1), ("s2", "Crew", "writes", 1, 1), ("w.tsx", "s1", "ui", 1, 1)]
    assert sorted(map(tuple, canvas.depths(spark, made).collect())) == [("a.py", 0), ("b.py", 1), ("c.py", 2)]


def test_settings(tmp_path):
    at = tmp_path / "c.toml"
    at.write_text('[graph]\nroots = ["lib/"]\n[[entry]]\nadapter = "cli"\ncommands = "tool"\n[[flow]]\nid = "f"\nproposed = ["new:a", "new:b"]\n[[flow]]\nid = "g"\nproposed = "new:c"\n')
    s = config.load(at)
    assert s.roots() == ["lib", "tool"] and s.flow_order() == ["f", "g"] and s.adopted() == {"new:a": "f", "new:b": "f", "new:c": "g"}
    assert config.load(tmp_path / "none.toml", ["x/main.py"]).entries == [{"adapter": "fastapi", "main": "x/main.py"}]


def test_results(spark, tmp_path):
    (tmp_path / "j.xml").write_text('<testsuite><testcase classname="m" name="a"/><testcase classname="m" name="b"><failure message="x">trace</failure></testcase><testcase classname="m" name="c"><skipped>why</skipped></testcase></testsuite>')
    assert sorted(map(tuple, results.junit(spark, str(tmp_path / "j.xml")).collect())) == [("m.a", "passed"), ("m.b", "failed"), ("m.c", "skipped")]
    (tmp_path / "k.json").write_text(json.dumps({"_about": "note", "p1": {"breaks_prod": True, "expected": "spreads", "affected": ["A", "B"]}, "p2": {"breaks_prod": True, "expected": "blind", "affected": []}, "p3": {"breaks_prod": False, "expected": "contained"}}))
    said = spark.createDataFrame([("p1", "spreads", ["A", "C"]), ("p2", "contained", [])], "id string, verdict string, spreads_to array<string>")
    got = results.score(results.answer_key(spark, str(tmp_path / "k.json")), said).first()
    assert tuple(got) == (3, 2, 1, 1, 2, 1, 2)


def test_what_a_page_shows(spark):
    stories = spark.createDataFrame([(1, [("t", ["a.py:f"], ["plan.md"], [])], []), (2, [], [])], story.STORY)
    hunks = spark.createDataFrame([(1, "a.py", ["a.py:f"]), (1, "plan.md", []), (1, "x.bin", None), (2, "b.py", [])], "change_no long, file string, symbols array<string>")
    assert sorted((r["change_no"], r["file"]) for r in story.shown_hunks(hunks, stories).collect()) == [(1, "a.py"), (1, "plan.md")]
    files = spark.createDataFrame([(c, p, k) for c in (1, 2) for p, k in (("t.py", "test"), ("d.md", "doc"), ("g.json", "generated"), ("c.py", "code"))], "change_no long, path string, kind string")
    assert sorted((r["change_no"], r["path"]) for r in story.folded(files, stories).collect()) == [(1, "g.json"), (1, "t.py"), (2, "d.md"), (2, "g.json"), (2, "t.py")]
    cards = spark.createDataFrame([("1", "web/a.ts"), ("2", "a.ts"), ("3", "lib/x/b.py"), ("4", "c.py")], "card string, path string")
    changed = spark.createDataFrame([("a.ts:f", "changed"), ("src/web/a.ts:g", "new"), ("x/b.py:h", "changed"), ("xc.py:i", "new")], "node string, kind string")
    assert {r["node"]: r["card"] for r in canvas.painted(cards, changed).collect()} == {"a.ts:f": "2", "src/web/a.ts:g": "1", "x/b.py:h": "3", "xc.py:i": None}
