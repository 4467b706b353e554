"""Results of test runs and of planted changes, and how verdicts score against an answer key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JUNIT = "`_name` string, `_classname` string, failure string, error string, skipped string"
KEY = "breaks_prod boolean, expected string, affected array<string>"


def junit(spark: SparkSession, path: str) -> DataFrame:
    """test, outcome ('passed', 'failed', 'skipped') of JUnit reports."""
    cases = spark.read.schema(JUNIT).format("xml").option("rowTag", "testcase").load(path)
    outcome = F.when(F.col("failure").isNotNull() | F.col("error").isNotNull(), "failed").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return cases.select(F.concat_ws(".", "_classname", "_name").alias("test"), outcome.alias("outcome"))


def answer_key(spark: SparkSession, path: str) -> DataFrame:
    """id, breaks_prod, expected, affected of one JSON object keyed by change; keys that begin with an underscore are notes."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    each = raw.select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("id", "v")).filter(~F.startswith("id", F.lit("_")))
    return each.select("id", *[F.try_variant_get("v", f"$.{n}", t).alias(n) for n, t in (x.split(" ", 1) for x in KEY.split(", "))])


def score(key: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: changes, breaking, quiet (breaking and called contained), right (the expected verdict), affected, recalled, flagged.

    verdicts: id, verdict, spreads_to (entry points said to be affected). A change without a verdict is wrong and recalls nothing."""
    none = F.array().cast("array<string>")
    met = key.join(verdicts, "id", "left").select("*", F.coalesce("affected", none).alias("a"), F.coalesce("spreads_to", none).alias("s"))
    count = lambda c: F.count(F.when(c, 1))
    return met.agg(
        F.count(F.lit(1)).alias("changes"),
        count(F.col("breaks_prod")).alias("breaking"),
        count(F.col("breaks_prod") & (F.col("verdict") == "contained")).alias("quiet"),
        count(F.col("verdict") == F.col("expected")).alias("right"),
        F.sum(F.size("a")).alias("affected"),
        F.sum(F.size(F.array_intersect("a", "s"))).alias("recalled"),
        F.sum(F.size("s")).alias("flagged"),
    )


def runtime_reach(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, tests) of a tracer's JSON: endpoint, symbol that it ran, and test, endpoint, symbol."""
    raw = spark.read.schema("endpoints map<string, array<string>>, tests map<string, struct<endpoints: array<string>, symbols: array<string>>>").json(path, multiLine=True)
    entries = raw.select(F.explode("endpoints").alias("endpoint", "s")).select("endpoint", F.explode("s").alias("symbol"))
    tests = raw.select(F.explode("tests").alias("test", "t")).select("test", F.explode_outer("t.endpoints").alias("endpoint"), "t.symbols").select("test", "endpoint", F.explode_outer("symbols").alias("symbol"))
    return entries, tests


def over_reported(verdicts: DataFrame, changed: DataFrame, ran: DataFrame) -> DataFrame:
    """id, endpoint: entry points that an analysis flags and that ran none of the changed symbols. verdicts: id, spreads_to; changed: id, symbol; ran: endpoint, symbol."""
    flagged = verdicts.select("id", F.explode("spreads_to").alias("endpoint")).distinct()
    seen = changed.join(ran, "symbol").select("id", "endpoint").distinct()
    return flagged.join(seen, ["id", "endpoint"], "left_anti")
