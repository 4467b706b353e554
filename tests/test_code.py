from __future__ import annotations

import ast
import json
import subprocess

import pytest

from changegraph.adapters import detect, routes, scan
from changegraph.functions import codec, render
from changegraph.parse import graph_of, outlines, python_source
from changegraph.sources import git
from changegraph.streaming import claims

FILES = {
    "tool/__init__.py": "",
    "tool/cmd.py": 'from tool import helper\nfrom tool.shapes import Square as Sq, area_of\nimport tool.shapes\n\nLIMIT = helper.top()\n\ndef main():\n    s = Sq()\n    s.area()\n    area_of(s)\n    tool.shapes\n\n    def inner():\n        return helper.top()\n    return inner()\n\nif __name__ == "__main__":\n    main()\n',
    "tool/helper.py": '"""Helpers."""\n\ndef top():\n    """Tops.\n\n    More."""\n    return low(1)\n\n\ndef low(x, y=2):\n    return "a".replace("a", "b")\n',
    "tool/shapes.py": "class Base:\n    def area(self):\n        return self.side()\n\n    def side(self):\n        return 1\n\n\nclass Square(Base):\n    def __init__(self):\n        self.n = 1\n\n    def area(self):\n        return self.side()\n\n\ndef area_of(x):\n    return x.area()\n",
    "tool/bad.py": "def broken(:\n",
    "api/main.py": "from api.users import router as users\nfrom api import items\napp.include_router(users, prefix='/v1')\napp.include_router(items.router)\napp.include_router(load('x').router)\n",
    "api/users.py": "router = APIRouter(prefix='/users')\n\n@router.get('/{id}')\ndef show(id):\n    return id\n\n@other.get('/no')\ndef no():\n    pass\n",
    "api/items.py": "router = APIRouter()\n\n@router.post('/items')\nasync def create():\n    pass\n",
    "web/src/app/(shop)/cart/[id]/route.ts": "// x\nexport async function GET() {}\nexport const POST = 1\n",
    "web/src/app/page.tsx": "\nexport default function Home() {}\n",
    "web/pages/api/ping.ts": "export default ping;\n",
    "web/app/actions.ts": "'use server'\nexport async function save() {}\n",
    "svc/reg.py": "def go():\n    bus.on('started', go)\n\ndef later():\n    pass\n\nbus.call('later', later)\n",
    "rb/app/controllers/users_controller.rb": "class UsersController < BaseController\n  include Listing\n  def show\n  end\nend\n",
    "rb/app/controllers/base_controller.rb": "class BaseController\n  def edit\n    1\n  end\nend\n",
    "rb/app/controllers/concerns/listing.rb": "module Listing\n  def index\n  end\nend\n",
    "rb/routes.txt": "  users GET /users(.:format) users#index\n        POST|PUT /users(.:format) users#show\n user GET /users/:id(.:format) users#edit\n x GET /x users#gone\n b GET /rails/b rails/info#show\n g GET /g gem/thing#go\n",
}


@pytest.fixture(scope="module")
def built(spark):
    files = spark.createDataFrame([("r", p, t) for p, t in FILES.items()], "ref string, path string, text string").cache()
    defs, edges, bad = graph_of.build(files)
    return files, defs.cache(), {(r["src"], r["dst"]) for r in edges.collect()}, [r["path"] for r in bad.collect()]


def test_call_graph(built):
    _, defs, edges, bad = built
    assert bad == ["tool/bad.py"]
    m, h, s = "tool/cmd.py:", "tool/helper.py:", "tool/shapes.py:"
    assert {(m + "main", s + "Square"), (m + "main", s + "Square.area"), (m + "main", s + "area_of"), (m + "main", m + "main.inner"), (m + "main.inner", h + "top"), (m + "__main__", m + "main"), (h + "top", h + "low"), (s + "Square", s + "Square.__init__"), (s + "area_of", s + "Base.area"), (s + "area_of", s + "Square.area"), (s + "Square.area", s + "Base.side")} <= edges
    assert not any(a == h + "low" for a, _ in edges)  # replace is a string's
    at = {(r["path"], r["name"]): (r["start"], r["end"]) for r in defs.collect()}
    assert at["tool/cmd.py", "__main__"] == (17, 18) and at["api/users.py", "show"] == (3, 5)
    assert at["web/src/app/page.tsx", "Home"] == (2, 3)


def test_entries(spark, built):
    files, defs, *_ = built
    specs = [
        {"adapter": "cli", "commands": "tool", "prog": "t"},
        {"adapter": "fastapi", "main": "api/main.py"},
        {"adapter": "nextjs", "root": "web"},
        {"adapter": "pattern", "files": ["svc/*.py"], "match": r"bus\.(?P<verb>on|call)\('(?P<what>\w+)', (?P<handler>\w+)", "endpoint": "{VERB} {what|verb}!{def}"},
        {"adapter": "list", "entries": [{"endpoint": "JOB a", "handler": "tool/helper.py:low"}, {"endpoint": "JOB b", "handler": "none.py:x"}, {"endpoint": "CLI t cmd", "handler": "x.py:y"}]},
        {"adapter": "rails", "root": "rb", "routes_file": "routes.txt"},
    ]
    entries, conflicts = scan(specs, files, defs)
    got = {r["endpoint"]: (r["handler"], r["line"]) for r in entries.collect()}
    ctl = "rb/app/controllers/"
    assert got == {
        "CLI t cmd": ("tool/cmd.py:__main__", 17),
        "GET /v1/users/{id}": ("api/users.py:show", 4),
        "POST /items": ("api/items.py:create", 4),
        "GET /cart/{id}": ("web/src/app/(shop)/cart/[id]/route.ts:GET", 2),
        "POST /cart/{id}": ("web/src/app/(shop)/cart/[id]/route.ts:POST", 3),
        "PAGE /": ("web/src/app/page.tsx:Home", 2),
        "ANY /api/ping": ("web/pages/api/ping.ts:ping", 1),
        "ACTION web/app/actions.ts#save": ("web/app/actions.ts:save", 2),
        "ON started!go": ("svc/reg.py:go", 2),
        "CALL later!later": ("svc/reg.py:later", 7),
        "JOB a": ("tool/helper.py:low", 10),
        "JOB b": ("none.py:x", 1),
        "GET /users": (ctl + "concerns/listing.rb:index", 2),
        "POST /users": (ctl + "users_controller.rb:show", 3),
        "PUT /users": (ctl + "users_controller.rb:show", 3),
        "GET /users/{id}": (ctl + "base_controller.rb:edit", 2),
        "GET /x": (ctl + "users_controller.rb:UsersController", 1),
    }
    rails = {r["endpoint"]: r for r in entries.collect()}
    assert rails["PUT /users"]["aliases"] == ["users_path", "users_url"] and rails["GET /x"]["implicit"] == "renders app/views/users/gone"
    assert [r["endpoint"] for r in conflicts.collect()] == ["CLI t cmd"]
    assert detect(["a/config/routes.rb", "b/next.config.js", "a/x.rb", "c/main.py", "d/main.py", "next.config.ts"], {"d/main.py": "print()"}) == [{"adapter": "nextjs", "root": "."}, {"adapter": "rails", "root": "a"}, {"adapter": "nextjs", "root": "b"}, {"adapter": "fastapi", "main": "c/main.py"}]


def looks(text):
    return {r[2]: (r[3], r[4]) for r in python_source.facts(text) if r[0] == "look"}


def test_source_functions():
    text = FILES["tool/helper.py"]
    assert looks(text)["low"][0] == "x, y=2" and "none" not in looks(text) and looks(FILES["tool/shapes.py"])["Square"][0] is None
    told = {r[2]: r[4] for r in python_source.facts(text + 'def last():\n    """One\n    two.\n\n    three"""\n') if r[0] == "told"}
    assert told == {"top": "Tops.", "last": "One two."}
    (f,) = ast.parse("def f(a: int, b, /, c=1, *d, e, g: str = 'x', **h): pass").body
    assert python_source.parameters(f) == "a: int, b, /, c=1, *d, e, g: str='x', **h"
    moved = text.replace("Tops.", "Changed.").replace("def low", "# note\n\ndef low")
    assert looks(text)["top"] == looks(moved)["top"] != looks(text)["low"]
    assert looks(text.replace("y=2", "y=3"))["low"] != looks(text)["low"]
    assert list(python_source.facts(None)) == [] and [r[0] for r in python_source.facts("def (")] == ["unparsed"]
    assert [r[0] for r in python_source.facts("x = " + "-" * 100_000 + "1")] == ["unparsed"]
    assert [(r[5], r[6]) for r in python_source.facts(FILES["tool/cmd.py"]) if r[0] == "live"] == [(5, 5), (17, 18)]


def test_outlines():
    assert outlines.ruby_outline("class A\n  def b\n  end\n  def c; 1 end\nend") == [("A.b", 2, 3), ("A", 1, 5)]
    ruby = "module M::N\n  class B < C\n    class << self\n      def x?(a) # end\n        return 1 if a\n        [1].each do |y|\n          while y do\n            z\n          end\n        end\n        v = if a then 1 else 2 end\n      end\n    end\n    def self.make=(x)\n      \"end\"\n    end\n  end\nend\n"
    assert outlines.ruby_outline(ruby) == [("M::N.B.x?", 4, 12), ("M::N.B.make=", 14, 16), ("M::N.B", 2, 17), ("M::N", 1, 18)]
    script = "// function no() {}\nconst a = 1;\nexport async function b() {\n  const inner = 2;\n  function deep() {}\n}\nclass C {\n  m() {}\n}\ninterface D { x: string }\ntype E = { y: 1 }\nnamespace N {\n  export const F = 3\n}\nexport function* g() {}\nlet s = 'function z() {}'\n"
    assert outlines.script_outline(script) == [("a", 2, 2), ("b", 3, 6), ("C", 7, 9), ("D", 10, 10), ("E", 11, 12), ("F", 13, 14), ("g", 15, 15), ("s", 16, 17)]
    assert outlines.script_outline(None) == outlines.ruby_outline("") == []


def test_route_parts():
    assert [routes.url_part(x) for x in ("(shop)", "@side", "(.)photo", "(..)(..)x", "[id]", "[...all]", "[[...some]]", "[[odd]]", "plain", "(a)b")] == [None, None, None, None, "{id}", "{all}", "{some}", "[[odd]]", "plain", "(a)b"]
    text = "// export default No\n'use strict'\nexport { a as GET, b }\nexport default async function () {}\nexport const [x] = 1"
    assert routes.exports(text) == (False, [("GET", "a", 3), ("b", "b", 3), ("default", "default", 4), ("[", "[", 5)])
    assert routes.exports("/* x */\n'use server'\nexport default thing\n") == (True, [("default", "thing", 3)])


def test_rails_rules(spark):
    dump = "Prefix Verb URI Pattern Controller#Action\n  a HEAD /a a#one\n OPTIONS|GET /b(/:c)/*d(.:format) a#two\n c GET /cable action_cable/x#y\n  POST / a#three\n GET /in a#inner\n"
    ctl = "app/controllers/"
    files = spark.createDataFrame([("r", p, t) for p, t in {"routes.txt": dump, ctl + "a_controller.rb": "class AController < APIBase\n  def one; end\n  def two\n  end\n  def three\n  end\nend\n", ctl + "a_p_i_base.rb": "class APIBase\n  def inner\n  end\nend\n", ctl + "action_cable/x_controller.rb": ""}.items()], "ref string, path string, text string")
    entries, _ = scan([{"adapter": "rails", "routes_file": "routes.txt"}], files, graph_of.definitions(files, graph_of.python_facts(files)))
    got = {r["endpoint"]: r["handler"].removeprefix(ctl) for r in entries.collect()}
    assert got == {"HEAD /a": "a_controller.rb:one", "OPTIONS /b/{c}/{d}": "a_controller.rb:two", "GET /b/{c}/{d}": "a_controller.rb:two", "POST /": "a_controller.rb:three", "GET /in": "a_p_i_base.rb:inner"}


def test_modules_passed_on_as_values(spark):
    tree = {"tool/__init__.py": "", "tool/plugins/__init__.py": "from . import loud\n\nPLUGINS = [loud]\n", "tool/plugins/loud.py": "def render(s):\n    return s.upper()\n\ndef quiet(s):\n    pass\n", "tool/each.py": "from tool import plugins\n\ndef render_all(s):\n    return [p.render(s) for p in plugins.PLUGINS]\n"}
    files = spark.createDataFrame([("r", p, t) for p, t in tree.items()], "ref string, path string, text string")
    edges = {(r["src"], r["dst"]) for r in graph_of.build(files)[1].collect()}
    assert edges == {("tool/each.py:render_all", "tool/plugins/loud.py:render")}


def test_git_source(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", tmp_path, "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    run("init", "-q")
    (tmp_path / "app/vendor").mkdir(parents=True)
    (tmp_path / "app/a.py").write_text("one\n-- two\nthree\n")
    (tmp_path / "app/vendor/v.py").write_text("v\n")
    (tmp_path / "gone.py").write_text("x\ny\n")
    run("add", "."), run("commit", "-qm", "1"), run("tag", "base")
    (tmp_path / "app/a.py").write_text("one\nthree\nfour\n")
    (tmp_path / "gone.py").unlink()
    run("add", "."), run("commit", "-qm", "2"), run("tag", "head")
    spark.dataSource.register(git.GitFiles)
    spark.dataSource.register(git.GitDiff)
    rows = spark.read.format("gitfiles").option("repo", str(tmp_path)).option("refs", "base,head").option("suffixes", ".py").option("filesPerTask", "1").load()
    assert sorted((r["ref"], r["path"]) for r in rows.collect()) == [("base", "app/a.py"), ("base", "gone.py"), ("head", "app/a.py")]
    diff = spark.read.format("gitdiff").option("repo", str(tmp_path)).option("base", "base").option("head", "head").load().collect()
    got = sorted((r["path"], r["deleted"], r["old_start"], r["old_lines"], r["new_start"], r["new_lines"], tuple(r["lines"])) for r in diff)
    assert got == [("app/a.py", False, 2, 1, 1, 0, ("--- two",)), ("app/a.py", False, 3, 0, 3, 1, ("+four",)), ("gone.py", True, 1, 2, 0, 0, ("-x", "-y"))]


def test_each_head_is_claimed_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()

    def event(n, **x):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"change": "1", "head": "a", "command": "git push", "body": n, "at": f"2025-01-0{n}T00:00:00Z"} | x))

    event("1"), event("2"), event("3", command="echo 'git push'"), event("4", change="2", command="X=1 git -C d push origin")
    claims.run(spark, src, out, check).awaitTermination()
    assert sorted((r["change"], r["head"]) for r in claims.current(spark, out).collect()) == [("1", "a"), ("2", "a")]
    event("5", head="b"), event("6")
    claims.run(spark, src, out, check).awaitTermination()
    event("7", head="c"), event("8", change="3")
    claims.run(spark, src, out, check).awaitTermination()
    assert sorted((r["change"], r["head"], r["body"]) for r in claims.current(spark, out).collect()) == [("1", "c", "7"), ("2", "a", "4"), ("3", "a", "8")]
    assert len({v for v, _ in claims._parts(spark, out).values()}) > 1  # a bucket that no event touched is as it was


def test_claims_that_expire(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()

    def event(n, at):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"change": "1", "head": "a", "command": "git push", "body": n, "at": at}))

    for n, at in (("1", "2025-01-01T00:00:00Z"), ("2", "2025-01-02T00:00:00Z"), ("3", "2025-03-01T00:00:00Z"), ("4", "2025-03-01T01:00:00Z")):
        event(n, at)
        claims.run(spark, src, out, check, late="10 days").awaitTermination()
    assert [r["body"] for r in claims.current(spark, out).collect()] in (["3"], ["4"])


def test_rendering():
    text = render.map_markdown([{"id": "f", "summary": "S", "steps": [{"id": "s", "step_name": None, "evidence": "agreed", "endpoints": ["GET /"]}]}])
    assert "| s | agreed | `GET /` |" in text
    assert render.mermaid([("b", "c"), ("a", "b"), ("a", "b")]).count("-->") == 2
    assert "</" not in render.page({"x": "</script>"}, "{data}") and "+2 more" in render.lens_markdown({"verdict": "spreads", "gained": list("abcdefghijkl")})
    assert "## Ties" in render.questions_markdown([{"endpoint": "E", "flows": ["b", "a"]}], [], [])


def test_fragments(spark):
    df = spark.createDataFrame([("é" * 500,), (None,), ("",)], "t string")
    packed = [r[0] for r in df.select(codec.fitted(codec.pack("t"))).collect()]
    assert codec.unpack(packed[0]) == "é" * 500 and packed[1] is None and codec.unpack(packed[2]) == ""


def test_large_facts_lose_diff_text_first(spark, tmp_path):
    import json
    import random

    from __spark_entry__ import queries

    rnd = random.Random(3)
    diff = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    files = [{"path": "a.py", "kind": "code"}, {"path": "b.md", "kind": "docs"}]
    facts = lambda code, docs, name="x": json.dumps({"name": name, "files": files, "hunks": [{"file": "a.py", "text": diff(code)}, {"file": "b.md", "text": diff(docs)}]})
    rows = [(1, facts(10, 10)), (2, facts(10, 90_000)), (3, facts(90_000, 10)), (4, facts(10, 10, diff(90_000))), (5, "no json " + diff(90_000))]
    spark.createDataFrame(rows, "change_no long, facts string").write.parquet(f"{tmp_path}/change_facts.parquet")
    got = {r["change_no"]: r["fragment"] for r in queries()["pack_fragment"](spark, str(tmp_path)).collect()}
    assert codec.unpack(got[1]) == rows[0][1] and got[4] is None and got[5] is None
    two, three = (json.loads(codec.unpack(got[k])) for k in (2, 3))
    assert [h["file"] for h in two["hunks"]] == ["a.py"] and two["trimmed"] == ["diff text of non-code files"]
    assert three["hunks"] == [] and three["trimmed"] == ["diff text of non-code files", "all diff text"] and three["files"] == files
