"""Votes of independent passes: plurality with thresholds and tie-breaks, co-occurrence, overlap, evidence.

Whatever the reference takes in order of first appearance has an explicit ordinal here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How sure a step is, from least to most.
LADDER = ("single-source", "contested", "agreed", "tested", "confirmed")


def threshold(n: Column) -> Column:
    """How many of n passes must agree: three quarters, but two at least."""
    return F.greatest(F.lit(2), F.ceil(n * 3 / 4)).cast("int")


def mode_first(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """by, value: the most frequent value of each group, of equal ones the first seen."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), F.col("o"), F.col(value))).alias(value))


def together(members: DataFrame, group: str, element: str) -> DataFrame:
    """a, b, n: how many groups hold both elements, a < b. A group is the entry points of one step, bounded by the record it stood in."""
    m = members.select(group, element).distinct()
    a, b = m.select(group, F.col(element).alias("a")), m.select(group, F.col(element).alias("b"))
    return a.join(b, group).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlaps(left: DataFrame, right: DataFrame, key_l: str, key_r: str, element: str, pair: Column | None = None, at_least: float = 0.0) -> DataFrame:
    """key_l, key_r, jaccard: pairs of sets, in rows of (key, element), with a common element; by an inverted list, no pair without one is made.

    pair: a condition on the two keys, which is part of the join. at_least: only pairs with this index or more; they share one of the
    n - ceil(at_least n) + 1 rarest elements of either set, so frequent elements make no candidates."""
    l, r = left.select(key_l, element).distinct(), right.select(key_r, element).distinct()
    nl, nr = l.groupBy(key_l).agg(F.count(F.lit(1)).alias("_nl")), r.groupBy(key_r).agg(F.count(F.lit(1)).alias("_nr"))
    fits = F.lit(True) if pair is None else pair
    if at_least > 0:
        common = l.select(element).unionByName(r.select(element)).groupBy(element).agg(F.count(F.lit(1)).alias("_f"))

        def rarest(sets: DataFrame, key: str) -> DataFrame:
            w = Window.partitionBy(key)  # a set is one record's
            ranked = sets.join(common, element).withColumn("_rn", F.row_number().over(w.orderBy("_f", element))).withColumn("_n", F.count(F.lit(1)).over(w))
            return ranked.filter(F.col("_rn") <= F.col("_n") - F.ceil(F.col("_n") * at_least - 1e-9) + 1).select(key, element)

        candidates = rarest(l, key_l).join(rarest(r, key_r), element).filter(fits).select(key_l, key_r).distinct()
        both = candidates.join(l, key_l).join(r, [key_r, element]).groupBy(key_l, key_r).agg(F.count(F.lit(1)).alias("_n"))
    else:
        both = l.join(r, element).filter(fits).groupBy(key_l, key_r).agg(F.count(F.lit(1)).alias("_n"))
    index = F.col("_n") / (F.col("_nl") + F.col("_nr") - F.col("_n"))
    return both.join(nl, key_l).join(nr, key_r).select(key_l, key_r, index.alias("jaccard")).filter(F.col("jaccard") >= at_least)


def rung(evidence: Column) -> Column:
    """Place of an evidence on the ladder, null if it isn't on it."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LADDER)), evidence), F.lit(0))
