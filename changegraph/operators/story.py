"""A change told in chapters, held against its facts: what the story claims that the change doesn't back, and what it leaves out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STORY = "change_no long, chapters array<struct<title: string, symbols: array<string>, files: array<string>, verified: array<struct<how: string, what: string>>>>, no_longer array<struct<was: string, cite: string, step: string>>"
#: How a claim may have been checked.
VERIFIED = ("test", "ran", "looked", "not checked")


def _chapters(stories: DataFrame) -> DataFrame:
    return stories.select("change_no", F.posexplode("chapters").alias("i", "c"))


def _at(field: str, *index: str) -> Column:
    """`chapters[0].symbols` and the like."""
    return F.format_string(field, *[F.col(x) for x in index])


def lint(stories: DataFrame, symbols: DataFrame, files: DataFrame, steps: DataFrame, shown: DataFrame, texts: DataFrame) -> DataFrame:
    """change_no, code, subject, problem. symbols(change_no, id), files(change_no, path), steps(change_no, key),
    shown(change_no, path, first, last): the lines that the diff shows, texts(change_no, path, text): test files at head. A story without chapters has no problems."""
    told = stories.filter(F.size("chapters") > 0)
    ch = _chapters(told)
    out = []
    named = ch.select("change_no", _at("chapters[%d].symbols", "i").alias("subject"), F.explode("c.symbols").alias("id"))
    out.append(("symbol-not-changed", named.join(symbols, ["change_no", "id"], "left_anti").select("change_no", "subject", F.col("id").alias("problem"))))
    claimed = ch.select("change_no", _at("chapters[%d].files", "i").alias("subject"), F.explode("c.files").alias("path"))
    out.append(("file-not-changed", claimed.join(files, ["change_no", "path"], "left_anti").select("change_no", "subject", F.col("path").alias("problem"))))
    gone = told.select("change_no", F.posexplode("no_longer").alias("i", "n")).select("change_no", "i", F.coalesce("n.cite", F.lit("")).alias("cite"), "n.step", _at("no_longer[%d].cite", "i").alias("subject"))
    rel, at = F.substring_index("cite", ":", 1), F.regexp_extract("cite", r"^[^:]*:(\d+(?:-\d+)?)$", 1)
    gone = gone.withColumn("path", rel).withColumn("first", F.when(at != "", F.substring_index(at, "-", 1).cast("int"))).withColumn("last", F.when(at != "", F.substring_index(at, "-", -1).cast("int")))
    on_map = gone.join(steps.withColumnRenamed("key", "cite"), ["change_no", "cite"], "left_semi")
    whole = gone.filter("first is null").join(files, ["change_no", "path"], "left_semi")
    lines = shown.select(F.col("change_no").alias("c2"), F.col("path").alias("p2"), F.col("first").alias("f2"), F.col("last").alias("l2"))
    partly = gone.join(lines, (F.col("change_no") == F.col("c2")) & (F.col("path") == F.col("p2")) & (F.col("first") <= F.col("l2")) & (F.col("f2") <= F.col("last")), "left_semi")
    backed = on_map.select("change_no", "i").unionByName(whole.select("change_no", "i")).unionByName(partly.select("change_no", "i"))
    out.append(("cite-not-in-diff", gone.join(backed.distinct(), ["change_no", "i"], "left_anti").select("change_no", "subject", F.col("cite").alias("problem"))))
    step = gone.filter("step <> ''").join(steps.withColumnRenamed("key", "step"), ["change_no", "step"], "left_anti")
    out.append(("step-not-on-map", step.select("change_no", _at("no_longer[%d].step", "i").alias("subject"), F.col("step").alias("problem"))))
    said = ch.select("change_no", "i", F.posexplode("c.verified").alias("j", "v")).select("change_no", "i", "j", "v.how", F.coalesce("v.what", F.lit("")).alias("what"))
    odd = said.filter(~F.coalesce("how", F.lit("")).isin(*VERIFIED))
    out.append(("verified-how", odd.select("change_no", _at("chapters[%d].verified[%d].how", "i", "j").alias("subject"), F.coalesce("how", F.lit("")).alias("problem"))))
    test = said.filter("how = 'test'").withColumn("path", F.substring_index("what", ":", 1)).withColumn("leaf", F.when(F.instr("what", ":") > 0, F.substring_index(F.substring_index("what", ":", -1), ".", -1)).otherwise(""))
    there = test.join(texts.select("change_no", "path", "text"), ["change_no", "path"], "left").filter(F.col("text").isNull() | ~F.contains("text", F.col("leaf")))
    out.append(("test-not-at-head", there.select("change_no", _at("chapters[%d].verified[%d].what", "i", "j").alias("subject"), F.col("what").alias("problem"))))
    return reduce(DataFrame.unionByName, [df.select("change_no", F.lit(f"story/{code}").alias("code"), "subject", "problem") for code, df in out])


def left_out(stories: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """change_no, kind ('unassigned' symbols, 'outside' files), subject: what changed and no chapter claims. files(change_no, path, kind)."""
    ch = _chapters(stories.filter(F.size("chapters") > 0))
    told = ch.select("change_no").distinct()
    s = symbols.join(told, "change_no", "left_semi").join(ch.select("change_no", F.explode("c.symbols").alias("id")), ["change_no", "id"], "left_anti")
    f = files.filter("kind in ('outside', 'doc')").join(told, "change_no", "left_semi").join(ch.select("change_no", F.explode("c.files").alias("path")), ["change_no", "path"], "left_anti")
    return s.select("change_no", F.lit("unassigned").alias("kind"), F.col("id").alias("subject")).unionByName(f.select("change_no", F.lit("outside").alias("kind"), F.col("path").alias("subject")))


def shown_hunks(hunks: DataFrame, stories: DataFrame) -> DataFrame:
    """The hunks that a page shows: those with symbols, and those of files that a chapter chose. hunks: change_no, file, symbols (array) and others."""
    chosen = _chapters(stories).select("change_no", F.explode("c.files").alias("file")).distinct().withColumn("_chosen", F.lit(True))
    return hunks.join(chosen, ["change_no", "file"], "left").filter((F.coalesce(F.size("symbols"), F.lit(0)) > 0) | F.col("_chosen")).drop("_chosen")


def folded(files: DataFrame, stories: DataFrame) -> DataFrame:
    """change_no, path: files of which a page shows the path alone: generated ones and tests, and without chapters documents and what lies outside. files: change_no, path, kind."""
    told = stories.filter(F.size("chapters") > 0).select("change_no").distinct().withColumn("_told", F.lit(True))
    met = files.join(told, "change_no", "left")
    return met.filter(F.col("kind").isin("generated", "test") | (F.col("kind").isin("doc", "outside") & F.col("_told").isNull())).select("change_no", "path")
