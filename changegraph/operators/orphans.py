"""References to records that do not exist, at the time of the reference.

Keys are composite and may be null in part. References are grouped by their null mask; each mask is anti-joined
on its non-null columns, under one of the match semantics of SQL's foreign keys:

* simple: a reference with any null column refers to nothing and is no orphan;
* partial: the non-null columns must match some target row; all-null references refer to nothing;
* full: columns are all null (refers to nothing) or all non-null; a mixed reference is an orphan of kind 'missing'.

A target row is live at t if live_from <= t and live_to is null or > t. Orphans are 'missing' if the key has no
target row at all, 'deleted' if some row began at or before t, 'late' otherwise.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _masked(refs: DataFrame, keys: list[str], mask: tuple[bool, ...]) -> DataFrame:
    return refs.filter(reduce(lambda a, b: a & b, (F.col(k).isNotNull() if m else F.col(k).isNull() for k, m in zip(keys, mask))))


def _free(taken: set[str], name: str) -> str:
    while name.lower() in taken:
        name += "_"
    taken.add(name.lower())
    return name


def orphans(refs: DataFrame, targets: DataFrame, keys: list[str], at: str = "at", live_from: str = "live_from", live_to: str = "live_to", match: str = "simple") -> DataFrame:
    """The rows of refs without a live target, with a column `kind` (one of that name in refs is replaced).

    refs: the key columns, `at` and any others (rows are kept as they are, repeats included); a null `at` is before all
    time. targets: the key columns and the two ends of life; a null live_from never lives, but its key is there.
    Which masks occur is asked first, by partial or full: at most 2^k rows for k columns, so refs had better be a written table then.
    Each mask shuffles its references once and the targets, reduced to distinct lives, once; an anti-join ends at the
    first live row. Of the references that are left only the first beginning per key is looked up, which is combined
    before it is shuffled. Both joins keep the reference side whole, so adaptive execution may split a hot key."""
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"no such match semantics: {match}")
    rest = [c for c in refs.columns if c != "kind" or c in keys]
    taken = {c.lower() for c in refs.columns}
    begin, end, first, there = (_free(taken, f"_{x}") for x in ("begin", "end", "first", "there"))
    parts = []
    masks = [(True,) * len(keys)]
    if match != "simple":
        there_are = {tuple(r) for r in refs.select(*[F.col(k).isNotNull() for k in keys]).distinct().collect()}
        masks = [m for m in product((True, False), repeat=len(keys)) if m in there_are or all(m)]
    for mask in masks:
        used = [k for k, m in zip(keys, mask) if m]
        part = _masked(refs.select(*rest), keys, mask)
        if not used:
            continue
        if match == "full" and len(used) < len(keys):
            parts.append(part.withColumn("kind", F.lit("missing")))
            continue
        to = [_free(taken, f"_to_{k}") for k in used]
        named = targets.select(*[F.col(k).alias(n) for k, n in zip(used, to)], F.col(live_from).alias(begin), F.col(live_to).alias(end)).dropna(subset=to)
        same = [F.col(k) == F.col(n) for k, n in zip(used, to)]
        forever = F.lit("9999-12-31").cast(targets.schema[live_to].dataType)
        lives = named.groupBy(*to, begin).agg(F.max(F.coalesce(end, forever)).alias(end))
        dead = part.join(lives, [*same, F.col(begin) <= F.col(at), F.col(end) > F.col(at)], "left_anti")
        firsts = named.groupBy(*to).agg(F.min(begin).alias(first), F.lit(True).alias(there))
        kind = F.when(F.col(there).isNull(), "missing").when(F.col(first) <= F.col(at), "deleted").otherwise("late")
        parts.append(dead.join(firsts, same, "left").withColumn("kind", kind).select(*rest, "kind"))
    return reduce(DataFrame.unionByName, parts)


def orphan_report(found: DataFrame, by: list[str], at: str = "at", period: str = "month") -> DataFrame:
    """Orphans per referring field and period: by, period_start, kind, orphans."""
    return found.groupBy(*by, F.date_trunc(period, at).alias("period_start"), "kind").agg(F.count(F.lit(1)).alias("orphans"))
