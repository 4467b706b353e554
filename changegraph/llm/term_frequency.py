"""Occurrences and records of every distinct term, with marks for terms too rare or too common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_frequency(records: DataFrame, terms: Column | str) -> DataFrame:
    """term, occurrences, records: over all rows of records, each of which is one record with an array of terms.

    Null terms and null or empty arrays count nothing; an empty string is a term like others. A record's terms are sorted, so that
    the first of each run of equal ones is known by its neighbour: a term's occurrences are all places, its records the first
    ones, and the work is that of the sort however long the record. Partial hash aggregation counts both per map task before the
    shuffle: a term that a third of all records hold reaches its reducer as one row per map task."""
    held = records.select(F.array_sort(F.array_compact(terms)).alias("_t"))
    marked = F.transform("_t", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (x != F.get("_t", i - 1))).alias("first")))
    places = held.select(F.explode(marked).alias("p")).select("p.term", "p.first")
    return places.groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"), F.count(F.when(F.col("first"), 1)).alias("records"))


def mark(frequency: DataFrame, total: int, rare: int = 1, common: float = 1 / 400) -> DataFrame:
    """frequency with `mark`: 'rare' if at most `rare` records hold the term, else 'common' if at least the share `common` of total does, else null."""
    least = F.lit(total * common)
    return frequency.withColumn("mark", F.when(F.col("records") <= rare, "rare").when(F.col("records") >= least, "common"))
