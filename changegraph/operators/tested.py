"""Which entry points tests name, and whether what a mapping pass cites is there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegraph.functions import paths

#: What a placeholder of a path stands for: no slash, blank, question mark or quote.
VALUE = "[^/\"'`?\\s]+"


def _between(text: Column, marks: str) -> Column:
    """The pieces of a text that have one of the marks on either side."""
    pieces = F.split(text, f"[{marks}]")
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))


def _tokens(texts: DataFrame, by: list[str]) -> DataFrame:
    """by, sort, value: words, quoted pieces, pieces of code, and modules that the texts name, each once."""
    t = F.col("text")
    sorts = {"word": F.split(t, r"\W+"), "quoted": _between(t, "'\""), "code": _between(t, "'\"`"), "module": F.concat(F.regexp_extract_all(t, F.lit(r"\b(\w+)\.py\b"), 1), F.regexp_extract_all(t, F.lit(r"\bimport\s+(\w+)\b"), 1))}
    each = [texts.select(*by, F.lit(sort).alias("sort"), F.explode(F.array_distinct(values)).alias("value")) for sort, values in sorts.items()]
    return reduce(DataFrame.unionByName, each).distinct()


def tested(entries: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """by, endpoint: the entry points that the texts name. entries: by, endpoint (`KIND rest`), handler, aliases; texts: by, text.

    A path is named if it stands somewhere with values for its placeholders and no longer word or path behind it; a command by its quoted
    name or its module's; an action by its function's name; others by their quoted name; all by an alias, a word as a word and
    anything else in quotes or code marks. What texts hold is cut out once and joined on equality: no pattern meets every text, and a
    path meets the paths that begin with the same word."""
    e = entries.select(*by, "endpoint", "handler", "aliases", paths.kind_of("endpoint").alias("kind"), F.expr("substring(endpoint, instr(endpoint, ' ') + 1)").alias("target"))
    path, cli, action = F.startswith("target", F.lit("/")), F.col("kind") == "CLI", F.col("kind") == "ACTION"
    command = cli & F.contains("target", F.lit(" "))
    module = F.regexp_replace(F.substring_index(paths.file_of("handler"), "/", -1), r"\.py$", "")
    key = lambda sort, value, when: F.when(when, F.struct(F.lit(sort).alias("sort"), value.alias("value")))
    plain = ~cli & ~action & ~path
    names = F.array(key("module", module, command), key("quoted", F.expr("substring(target, instr(target, ' ') + 1)"), command), key("word", F.substring_index("target", "#", -1), action), key("quoted", F.col("target"), plain))
    alias = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.when(a.rlike(r"^\w+$"), "word").otherwise("code").alias("sort"), a.alias("value")))
    keys = e.select(*by, "endpoint", F.explode(F.array_compact(F.concat(names, alias))).alias("k")).select(*by, "endpoint", "k.sort", "k.value").filter("value <> ''")
    named = keys.join(_tokens(texts, by), [*by, "sort", "value"], "left_semi").select(*by, "endpoint")

    literal = F.concat(F.lit(r"^\Q"), F.regexp_replace("target", r"\{[^}]+\}", r"\\E" + VALUE.replace("\\", "\\\\") + r"\\Q"), F.lit(r"\E(?![\w/])"))
    begin = lambda c: F.regexp_extract(c, r"^/(\w*)", 1)
    patterns = e.filter(path & ~cli & ~action).select(*by, "endpoint", begin("target").alias("begin"), literal.alias("pattern"))
    whole = texts.select(*by, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"/[^\s\"'`?]*"), 0))).alias("p")).distinct()
    # from every slash on
    rest = whole.withColumn("parts", F.split("p", "/")).select(*by, F.explode(F.transform(F.sequence(F.lit(2), F.size("parts")), lambda k: F.concat(F.lit("/"), F.array_join(F.slice("parts", k, F.size("parts")), "/")))).alias("p")).distinct()
    said = rest.select(*by, "p", F.explode(F.array_distinct(F.array(begin("p"), F.lit("")))).alias("begin"))
    met = patterns.join(said, [*by, "begin"]).filter(F.rlike("p", "pattern")).select(*by, "endpoint")
    return named.unionByName(met).distinct()


def problems(cites: DataFrame, anchors: DataFrame, known: DataFrame, files: DataFrame, defs: DataFrame, by: list[str]) -> DataFrame:
    """by, place, problem, subject: what a pass cites and isn't there.

    cites: by, place, endpoint; anchors: by, place, anchor; known: by, endpoint; files: by, file; defs: by, file, sym. An anchor is sound if
    its file is there and defines each part of its symbol; `default` and `__main__` must be definitions like others."""
    unknown = cites.join(known.select(*by, "endpoint"), [*by, "endpoint"], "left_anti").select(*by, "place", F.lit("unknown entry point").alias("problem"), F.col("endpoint").alias("subject"))
    bare = anchors.filter(F.instr("anchor", ":") == 0).select(*by, "place", F.lit("no symbol").alias("problem"), F.col("anchor").alias("subject"))
    cut = anchors.filter(F.instr("anchor", ":") > 0).withColumn("file", paths.file_of("anchor"))
    lost = cut.join(files.select(*by, "file"), [*by, "file"], "left_anti").select(*by, "place", F.lit("file missing").alias("problem"), F.col("anchor").alias("subject"))
    there = cut.join(files.select(*by, "file"), [*by, "file"], "left_semi")
    parts = there.select(*by, "place", "anchor", "file", F.explode(F.split(paths.symbol_of("anchor"), r"\.")).alias("part"))
    defined = defs.select(*by, "file", F.explode(F.split("sym", r"\.")).alias("part")).distinct()
    odd = parts.join(defined, [*by, "file", "part"], "left_anti").select(*by, "place", F.lit("symbol not defined").alias("problem"), F.col("anchor").alias("subject"))
    return reduce(DataFrame.unionByName, (unknown, bare, lost, odd)).distinct()


def missing(known: DataFrame, placed: DataFrame, declared: DataFrame, by: list[str]) -> DataFrame:
    """by, endpoint: the entry points that a pass neither places nor declares unplaced."""
    told = placed.select(*by, "endpoint").unionByName(declared.select(*by, "endpoint"))
    return known.select(*by, "endpoint").join(told, [*by, "endpoint"], "left_anti")
