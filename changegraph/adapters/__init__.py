"""Entry points of a code base, from files(ref, path, text) and definitions(ref, path, name, start, end).

An adapter is a function (spec, files, defs) -> DataFrame of SCHEMA; ADAPTERS holds them by name, and others may be added.
`scan` runs those a configuration names and keeps the first row of each entry point.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegraph.adapters import code, routes

SCHEMA = "ref string, endpoint string, handler string, line int, aliases array<string>, implicit string"
ADAPTERS = {"cli": code.cli, "fastapi": code.fastapi, "pattern": code.pattern, "list": code.listed, "nextjs": routes.nextjs, "rails": routes.rails}


def _shaped(df: DataFrame) -> DataFrame:
    empty: dict[str, Column] = {"aliases": F.array().cast("array<string>"), "implicit": F.lit(None).cast("string")}
    return df.select("ref", "endpoint", "handler", F.col("line").cast("int").alias("line"), *[(F.col(n) if n in df.columns else c).alias(n) for n, c in empty.items()])


def scan(specs: list[dict], files: DataFrame, defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, conflicts): the first row of each entry point in order of the specs and of path and line, and entry points with several handlers."""
    parts = [_shaped(ADAPTERS[s["adapter"]](s, files, defs)).withColumn("spec", F.lit(i)) for i, s in enumerate(specs)]
    every = reduce(DataFrame.unionByName, parts)
    row = ["spec", "handler", "line", "aliases", "implicit"]
    entries = every.groupBy("ref", "endpoint").agg(F.min(F.struct(*row)).alias("r")).select("ref", "endpoint", *[f"r.{c}" for c in row[1:]])
    conflicts = every.groupBy("ref", "endpoint").agg(F.countDistinct("handler").alias("handlers")).filter("handlers > 1")
    return entries, conflicts


def detect(paths: list[str], texts: dict[str, str] | None = None) -> list[dict]:
    """What adapters the look of a tree calls for. texts: of main files, where known: one that makes no FastAPI application is none of its."""
    have, out, texts = set(paths), [], texts or {}
    tops = {p.rsplit("/", 1)[0] + "/" if "/" in p else "" for p in have}
    for top in sorted(tops):
        if set(top.split("/")) & {"node_modules", ".venv"}:
            continue
        if f"{top.removesuffix('config/')}config/routes.rb" in have and top.endswith("config/"):
            out.append({"adapter": "rails", "root": top.removesuffix("config/").strip("/") or "."})
        if any(f"{top}next.config.{x}" in have for x in ("js", "mjs", "ts")):
            out.append({"adapter": "nextjs", "root": top.strip("/") or "."})
        main = f"{top}main.py"
        if main in have and (main not in texts or "FastAPI(" in texts[main]):
            out.append({"adapter": "fastapi", "main": main})
    return out
