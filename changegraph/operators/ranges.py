"""Joins of places with intervals: innermost enclosing, nearest before, overlapping.

Intervals and places are cut into bins of BIN units, so that the join is on equal keys and a file with a third of all definitions
is spread over its bins; an interval longer than MOST bins is cut into bins of MOST times their size, and so on upwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN, MOST = 64, 64


def _binned(intervals: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    first, last = F.floor(F.col(start) / BIN), F.floor(F.col(end) / BIN)
    sound = intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    short = sound.filter(last - first < MOST).withColumn("_bin", F.explode(F.sequence(first, last)))
    return short, sound.filter(last - first >= MOST)


#: Sizes of bins: an interval lies in at most MOST + 1 bins of the first size that allows it; the last one holds any 64-bit length.
SIZES = [BIN * MOST**k for k in range(8)]


def _layered(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Intervals once for each bin they lie in, `_size` and `_bin`."""
    sound = intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    length = F.col(end).cast("bigint") - F.col(start)
    size = F.coalesce(*[F.when(length < n * MOST, F.lit(n)) for n in SIZES[:-1]], F.lit(SIZES[-1]))
    sized = sound.withColumn("_size", size)
    return sized.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / F.col("_size")), F.floor(F.col(end) / F.col("_size")))))


def containing(places: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Every pair of a place and an interval with equal `by` that contains it, both ends included. Columns must not clash but for `by`."""
    inside = (F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))
    cut = _layered(intervals, start, end)
    used = cut.select("_size").distinct()  # at most as many rows as there are sizes
    sizes = [r[0] for r in used.collect()]
    if not sizes:
        return places.join(cut.drop("_size", "_bin"), by).filter(inside)
    asked = places.withColumn("_size", F.explode(F.array(*map(F.lit, sorted(sizes))))).withColumn("_bin", F.floor(F.col(at) / F.col("_size")))
    return asked.join(cut, [*by, "_size", "_bin"]).filter(inside).drop("_size", "_bin")


def innermost(places: DataFrame, intervals: DataFrame, by: list[str], place: list[str], at: str, order: str, start: str = "start", end: str = "end") -> DataFrame:
    """Each place once with the enclosing interval of greatest start, of equal ones the first in `order`; nulls where none encloses it.

    place: the columns that name a place. The pick is an aggregate with partial combination, no window over a hot place."""
    rest = [c for c in intervals.columns if c not in by]
    pick = F.max_by(F.struct(*rest), F.struct(F.col(start), -F.col(order))).alias("_in")
    met = containing(places.select(*dict.fromkeys([*by, *place, at])), intervals, by, at, start, end).groupBy(*place).agg(pick)
    return places.join(met, place, "left").select(*places.columns, *[F.col(f"_in.{c}").alias(c) for c in rest])


def nearest(places: DataFrame, things: DataFrame, by: list[str], place: list[str], at: str, where: str, order: str) -> DataFrame:
    """Each place with the thing of equal `by` that starts last at or before it, else the one that starts first after it; of equal ones the first in `order`.

    A place meets the things of its bin only; what the bins before and behind it hold is known from their first and last things, one
    row per bin. So a file with a third of all things is spread, and no place meets all of them."""
    rest = [c for c in things.columns if c not in by]
    thing = F.struct(*rest)
    latest, soonest = F.struct(F.col(where), -F.col(order)), F.struct(-F.col(where), -F.col(order))
    cut = things.filter(F.col(where).isNotNull()).withColumn("_bin", F.floor(F.col(where) / BIN))
    asked = places.select(*dict.fromkeys([*by, *place, at])).withColumn("_bin", F.floor(F.col(at) / BIN))
    ends = cut.groupBy(*by, "_bin").agg(F.max_by(thing, latest).alias("_l"), F.max_by(thing, soonest).alias("_f"))
    bins = ends.join(asked.select(*by, "_bin").distinct(), [*by, "_bin"], "full")
    up, down = (Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_bin"), F.desc("_bin")))
    around = bins.select(*by, "_bin", F.last("_l", ignorenulls=True).over(up).alias("_l"), F.last("_f", ignorenulls=True).over(down).alias("_f"))
    before = F.col(where) <= F.col(at)
    met = asked.join(cut, [*by, "_bin"]).groupBy(*place).agg(F.max_by(F.when(before, thing), F.when(before, latest)).alias("_b"), F.max_by(F.when(~before, thing), F.when(~before, soonest)).alias("_a"))
    best = asked.join(around, [*by, "_bin"]).join(met, place, "left").select(*place, F.coalesce("_b", "_l", "_a", "_f").alias("_in"))
    return places.join(best, place, "left").select(*places.columns, *[F.col(f"_in.{c}").alias(c) for c in rest])


def overlapping(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str, r_start: str, r_end: str) -> DataFrame:
    """Rows of left that overlap some row of right with equal `by`, both ends included: the later start of a pair lies in the other."""
    lshort, llong = _binned(left, start, end)
    rshort, rlong = _binned(right.select(*by, r_start, r_end), r_start, r_end)
    meets = (F.col(start) <= F.col(r_end)) & (F.col(r_start) <= F.col(end))
    named = lambda df, on: df.select(*[F.col(c).alias(f"_r_{c}") for c in on], F.col(r_start).alias("_rs"), F.col(r_end).alias("_re"))
    meets = (F.col(start) <= F.col("_re")) & (F.col("_rs") <= F.col(end))

    def semi(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        return a.join(named(b, on), [*(F.col(c) == F.col(f"_r_{c}") for c in on), meets], "left_semi")

    near = semi(lshort, rshort, [*by, "_bin"]).drop("_bin")
    far = semi(left, rlong, by).unionByName(semi(llong, right, by))
    return near.unionByName(far).distinct()


def numbered(df: DataFrame, by: list[str], order: list, name: str = "rn") -> DataFrame:
    """Rows numbered from 1 within `by`, in a total order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_in(df: DataFrame, by: list[str], order: list, most: int, name: str = "pos") -> DataFrame:
    """The first `most` rows of each group, numbered from 1. Spark keeps only so many of a group before and behind the shuffle."""
    return numbered(df, by, order, name).filter(F.col(name) <= most)


#: Numbers of an order that a running value is taken over in one task.
STRETCH = 100_000


def running_count(df: DataFrame, by: list[str], order: str, flag: Column, name: str) -> DataFrame:
    """df with the number of rows of equal `by` up to each in `order` that have the flag.

    Numbers are cut into stretches: what stands before a stretch is a sum over one row per stretch, so a hot `by` is no one task's."""
    cut = df.withColumn("_s", F.floor(F.col(order) / STRETCH)).withColumn("_f", F.when(flag, 1).otherwise(0))
    sums = cut.groupBy(*by, "_s").agg(F.sum("_f").alias("_n"))
    before = sums.select(*by, "_s", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    within = F.sum("_f").over(Window.partitionBy(*by, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_w", within).join(before, [*by, "_s"]).select(*df.columns, (F.col("_b") + F.col("_w")).alias(name))


def last_before(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """df with the last value that isn't null of equal `by` up to each row in `order`; by stretches, as running_count."""
    cut = df.withColumn("_s", F.floor(F.col(order) / STRETCH))
    known = cut.filter(F.col(value).isNotNull()).groupBy(*by, "_s").agg(F.max_by(value, order).alias("_v"))
    every = cut.select(*by, "_s").distinct().join(known, [*by, "_s"], "left")
    before = every.select(*by, "_s", F.last("_v", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)).alias("_b"))
    within = F.last(value, ignorenulls=True).over(Window.partitionBy(*by, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_w", within).join(before, [*by, "_s"]).select(*df.columns, F.coalesce("_w", "_b").alias(name))
