"""Entry points that Python code declares, that a rule finds, or that are listed by hand."""

from __future__ import annotations

import ast
import fnmatch
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changegraph.operators.ranges import innermost, nearest
from changegraph.parse import python_source
from changegraph.session import Stash

#: The verbs of routes.
VERBS = ("get", "post", "put", "patch", "delete")


def cli(spec: dict, files: DataFrame, defs: DataFrame) -> DataFrame:
    """Scripts with a main guard: `main` is the program itself, each file directly in `commands` a command of it."""
    folder = spec.get("commands", "").strip("/")
    prog = spec.get("prog") or (folder or spec.get("main", "cli").removesuffix(".py")).rsplit("/", 1)[-1]
    guards = defs.filter("name = '__main__'").select("ref", "path", F.col("start").alias("line"))
    whole = guards.filter(F.col("path") == spec.get("main", "")).withColumn("endpoint", F.lit(f"CLI {prog}"))
    stem = F.regexp_extract("path", rf"^{re.escape(folder)}/([^/]+)\.py$", 1)
    each = guards.filter((stem != "") & F.lit(bool(folder))).withColumn("endpoint", F.concat(F.lit(f"CLI {prog} "), stem))
    return whole.unionByName(each).select("ref", "endpoint", F.concat(F.col("path"), F.lit(":__main__")).alias("handler"), "line")


def _text_of(node) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _prefix(call: ast.Call) -> str:
    return next((_text_of(k.value) or "" for k in call.keywords if k.arg == "prefix"), "")


def _declared(text: str | None) -> Iterator[tuple]:
    """(kind, name, value, target, line): routers and their prefixes, what each local name was imported as, mounts, routes."""
    tree = python_source.parsed(text)
    for node in ast.walk(tree) if tree else ():
        match node:
            case ast.Assign(value=ast.Call(func=ast.Name(id="APIRouter")) as call):
                for t in node.targets:
                    if isinstance(t, ast.Name):
                        yield "router", t.id, _prefix(call), None, node.lineno
            case ast.ImportFrom(module=str() as module):
                for a in node.names:
                    yield "import", a.asname or a.name, a.name, module, node.lineno
            case ast.Call(func=ast.Attribute(attr="include_router"), args=[ast.Attribute(value=ast.Name(id=held), attr=router), *_]):
                yield "mount", held, _prefix(node), router, node.lineno
            case ast.Call(func=ast.Attribute(attr="include_router"), args=[ast.Name(id=held), *_]):
                yield "mount", held, _prefix(node), None, node.lineno
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                for d in node.decorator_list:
                    match d:
                        case ast.Call(func=ast.Attribute(attr=verb, value=ast.Name(id=router))) if verb in VERBS:
                            yield "route", router, f"{verb.upper()} {(_text_of(d.args[0]) or '') if d.args else ''}", node.name, node.lineno


def _declarations(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, p, *x) for r, p, t in zip(*(c.to_pylist() for c in batch.columns)) for x in _declared(t)]
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.string()] * 6 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["ref", "path", "kind", "name", "value", "target", "line"])

    return files.filter(F.endswith("path", F.lit(".py"))).select("ref", "path", "text").mapInArrow(run, "ref string, path string, kind string, name string, value string, target string, line int")


def fastapi(spec: dict, files: DataFrame, defs: DataFrame) -> DataFrame:
    """Routes of routers that the main file mounts: mount prefix, router prefix, route. Mounts that resolve to no file give nothing.

    What is mounted as `x.router` is the router of that name in the module imported as x; what is mounted as `x` is a router x of the
    module it is imported from, or all routers of a module of that name. Which it is the files tell."""
    said = Stash(files.sparkSession).put(_declarations(files))
    main = said.filter(F.col("path") == spec["main"])
    mounted = main.filter("kind = 'mount'").select("ref", "name", F.col("value").alias("mount"), F.col("target").alias("of"))
    named = main.filter("kind = 'import'").groupBy("ref", "name").agg(F.max_by(F.struct("target", F.col("value").alias("what")), "line").alias("i"))
    inside = F.struct(F.concat_ws(".", "i.target", "i.what").alias("module"), F.col("of").alias("only"))
    itself = F.when(F.col("of").isNull(), F.struct(F.col("i.target").alias("module"), F.col("i.what").alias("only")))
    places = mounted.join(named, ["ref", "name"]).select("ref", "mount", F.explode(F.array_compact(F.array(inside, itself))).alias("p")).select("ref", "mount", "p.only", F.replace("p.module", F.lit("."), F.lit("/")).alias("place"))
    wanted = places.select("ref", "mount", "only", F.explode(F.array(F.concat("place", F.lit(".py")), F.concat("place", F.lit("/__init__.py")))).alias("tail"))
    # the package may lie in the main file's directory or in one above it
    above = spec["main"].split("/")[:-1]
    roots = ["/".join(above[:k]) for k in range(len(above), -1, -1)]
    spots = wanted.withColumn("path", F.explode(F.array(*[F.concat(F.lit(f"{r}/" if r else ""), "tail") for r in roots])))
    modules = spots.join(files.select("ref", "path"), ["ref", "path"], "left_semi").select("ref", "path", "mount", "only").distinct()
    routers = said.filter("kind = 'router'").select("ref", "path", "name", F.col("value").alias("prefix"))
    routes = said.filter("kind = 'route'").select("ref", "path", "name", F.substring_index("value", " ", 1).alias("verb"), F.expr("substr(value, instr(value, ' ') + 1)").alias("route"), "target", "line")
    met = routes.join(routers, ["ref", "path", "name"]).join(modules, ["ref", "path"]).filter("only is null or only = name")
    return met.select("ref", F.concat("verb", F.lit(" "), "mount", "prefix", "route").alias("endpoint"), F.concat_ws(":", "path", "target").alias("handler"), "line")


def pattern(spec: dict, files: DataFrame, defs: DataFrame) -> DataFrame:
    """Matches of a rule: `files` globs, `match` with named groups, `endpoint` with {group}, {GROUP} in upper case, {a|b} the first that is there.

    The handler is the innermost definition that holds the match, or with a group `handler` the nearest of that name; a match that neither gives is left out."""
    globs = [re.compile(fnmatch.translate(g)) for g in spec["files"]]
    rule, template = re.compile(spec["match"], re.M), spec["endpoint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ref, path, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text and any(g.match(path) for g in globs):
                    for m in rule.finditer(text):
                        groups = {k: v for k, v in m.groupdict().items() if v}
                        rows.append((ref, path, text.count("\n", 0, m.start()) + 1, groups.get("handler"), list(groups.items())))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["ref", "path", "line", "named", "groups"])

    found = files.select("ref", "path", "text").mapInArrow(run, "ref string, path string, line int, named string, groups map<string,string>")
    found = found.withColumn("place", F.concat_ws(":", "ref", "path", F.col("line").cast("string"), F.xxhash64(F.map_entries("groups")).cast("string"))).dropDuplicates(["place"])
    things = defs.select("ref", "path", "name", "start", "end", F.substring_index("name", ".", -1).alias("leaf"), F.struct("start", "name").alias("o")).withColumn("n", F.xxhash64("o") % 1_000_000).drop("o")
    by_place = innermost(found.filter("named is null"), things, ["ref", "path"], ["place"], "line", "n")
    by_name = nearest(found.filter("named is not null").withColumn("leaf", F.col("named")), things, ["ref", "path", "leaf"], ["place"], "line", "start", "n").drop("leaf")
    both = by_place.select(*found.columns, "name").unionByName(by_name.select(*found.columns, "name")).filter("name is not null")

    def value(key: str):
        low = F.element_at("groups", F.lit(key.lower()))
        if key == "def":
            return F.substring_index("name", ".", -1)
        return F.element_at("groups", F.lit(key)) if key != key.upper() else F.coalesce(F.element_at("groups", F.lit(key)), F.upper(low))

    pieces = []
    for i, piece in enumerate(re.split(r"\{([^}]+)\}", template)):
        pieces.append(F.lit(piece) if i % 2 == 0 else F.coalesce(*[value(k) for k in piece.split("|")], F.lit("")))
    return both.select("ref", F.concat(*pieces).alias("endpoint"), F.concat_ws(":", "path", "name").alias("handler"), "line")


def listed(spec: dict, files: DataFrame, defs: DataFrame) -> DataFrame:
    """Entry points given by hand; the line is their definition's, else 1."""
    each = files.select("ref").distinct().select("ref", F.explode(F.array(*[F.struct(F.lit(e["endpoint"]).alias("endpoint"), F.lit(e["handler"]).alias("handler")) for e in spec["entries"]])).alias("e")).select("ref", "e.*")
    starts = defs.select("ref", F.concat_ws(":", "path", "name").alias("handler"), "start").groupBy("ref", "handler").agg(F.min("start").alias("start"))
    return each.join(starts, ["ref", "handler"], "left").select("ref", "endpoint", "handler", F.coalesce("start", F.lit(1)).alias("line"))
