"""Change facts from raw JSON text of several layouts, as typed tables. Stays in the JVM: the text becomes a variant once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "array<struct<id string, file string, sym string, status string, contract boolean, signature array<string>, steps array<string>, kept_calls int, callers array<struct<id string, edited boolean>>>>"
FILES = "array<struct<path string, kind string, added int, removed int>>"
VERDICT = "struct<verdict string, blind array<string>, spreads_to array<string>>"


def records(df: DataFrame, key: str = "change_no", text: str = "facts") -> DataFrame:
    """key, r: the record of each change as a variant; texts encoded twice and records under a key `facts` are unwrapped.

    Null, empty and incomplete texts give no row; of a change that comes again one row is kept."""
    v = df.select(key, F.try_parse_json(text).alias("v")).dropDuplicates([key])
    v = v.select(key, F.when(F.schema_of_variant("v") == "STRING", F.try_parse_json(F.try_variant_get("v", "$", "string"))).otherwise(F.col("v")).alias("v"))
    return v.select(key, F.coalesce(F.try_variant_get("v", "$.facts", "variant"), F.col("v")).alias("r")).filter("r is not null")


def field(path: str, kind: str) -> Column:
    """A field of `r`, null where it is missing or of another kind."""
    return F.try_variant_get("r", f"$.{path}", kind)


def symbols(recs: DataFrame, key: str = "change_no") -> DataFrame:
    return recs.select(key, F.posexplode(field("symbols", SYMBOLS)).alias("pos", "s")).select(key, "pos", "s.*")


def files(recs: DataFrame, key: str = "change_no") -> DataFrame:
    return recs.select(key, F.posexplode(field("files", FILES)).alias("pos", "f")).select(key, "pos", "f.*")
