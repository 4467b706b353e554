"""All pairs of records whose sets overlap above a Jaccard threshold, by T-occurrence merging of inverted lists.

1. Values become 64-bit hashes; whether two values share one is checked against a second hash, and then all are hashed anew with
   another seed. Records with equal sets, by hashes of 96 bits of the sorted values, form one class; the join runs on classes
   and its result is expanded at the end, or kept as links of classes (class_links) where copies are many.
2. The values of a class are put in order of rarity: the number of classes that hold them, counted over all classes.
3. Two sets that reach the threshold share one of their `n - ceil(t n) + 1` rarest values, so each class goes to the
   partitions of these values. A partition of more than BLOCK classes is cut into blocks, and every pair of
   blocks becomes a partition of its own: no task holds more than two blocks, however hot the value.
4. In a partition the classes are put into inverted lists. A class of n values probes them for the members that occur in
   at least T = ceil(t n) of its lists: the longest lists are put aside and only searched by bisection for members found
   otherwise; the rest are merged through a heap which skips members that can't reach the count any more.
5. A pair is emitted in the partition of its rarest common value only, so none comes twice.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changegraph.session import Stash, tasks_for

BLOCK = 4000
CLASSES_A_TASK = 200_000
#: Cost of a search relative to a merge step, for the number of lists put aside.
MU = 0.0085


def occurring(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(member, count) of those in at least `least` of the sorted lists."""
    n = len(lists)
    if n < least:
        return []
    lists = sorted(lists, key=len)
    aside = min(least - 1, int(least / (MU * log2(len(lists[-1]) + 1) + 1)))
    merged, searched, need = lists[: n - aside], lists[n - aside :], least - aside
    heap = [(x[0], i, 0) for i, x in enumerate(merged)]
    heapq.heapify(heap)
    found = []
    while len(heap) >= need:
        member, popped = heap[0][0], []
        while heap and heap[0][0] == member:
            popped.append(heapq.heappop(heap))
        count = len(popped)
        if count >= need:
            for x in searched:
                at = bisect_left(x, member)
                count += at < len(x) and x[at] == member
            if count >= least:
                found.append((member, count))
            goal = member + 1
        else:  # with need - 1 lists out of the heap, nothing below its top can reach the count
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            goal = heap[0][0]
        for _, i, at in popped:
            x = merged[i]
            at = at + 1 if goal == member + 1 and x[at] == member else bisect_left(x, goal, at)
            if at < len(x):
                heapq.heappush(heap, (x[at], i, at))
    return found


def _pairs_of(value: int, crossing: bool, members: list[tuple[int, bool, list[int], int]], num: int, den: int) -> Iterator[tuple[int, int, int]]:
    """(class, class, overlap) for the pairs of a partition. members: class, whether in the second block, ids, size of the set.

    crossing: only pairs of the first block with the second. Values of one class alone have no id, they only add to its size."""
    lists: dict[int, list[int]] = {}

    def index(i: int, ids: list[int]) -> None:
        for t in ids:
            lists.setdefault(t, []).append(i)

    if crossing:
        for i, (_, second, ids, _) in enumerate(members):
            if not second:
                index(i, ids)
    for i, (cls, second, ids, n) in enumerate(members):
        if not crossing or second:
            for j, overlap in occurring([lists[t] for t in ids if t in lists], -(-n * num // den)):
                other, _, theirs, m = members[j]
                if overlap * den >= num * (n + m - overlap):
                    rarer = ids[: ids.index(value)]
                    if not rarer or set(rarer).isdisjoint(theirs):
                        yield min(cls, other), max(cls, other), overlap
        if not crossing:
            index(i, ids)


def _hash(value: Column, seed: int) -> Column:
    return F.xxhash64(value, F.lit(seed))


#: So many seeds are tried; that each has a collision among 10^12 values has a chance of less than one in 10^10.
SEEDS = 16


def set_classes(spark: SparkSession, stash: Stash, records: DataFrame, record: str, values: Column | str) -> tuple[DataFrame, DataFrame]:
    """members(record, class_no), classes(class_no, values): class_no is the smallest record with exactly these values.

    Null values, null and empty sets belong to no class. What is shuffled from here on are numbers; values are told apart by
    their hashes, which are checked, and sets by the hashes and the number of their values."""
    kept = F.array_distinct(F.array_compact(values))
    for seed in range(SEEDS):
        each = F.transform(kept, lambda x: F.struct(_hash(x, seed).alias("v"), F.hash(x).alias("g")))
        sets = stash.put(records.select(F.col(record).alias("record"), F.sort_array(each).alias("each")))
        values_of = sets.select(F.explode("each").alias("e")).groupBy("e.v").agg(F.min("e.g").alias("a"), F.max("e.g").alias("b"))
        if values_of.filter("a <> b").isEmpty():
            break
        stash.drop(sets)
    else:
        raise RuntimeError("values collide under every seed")
    of = F.col("each.v")
    keyed = sets.filter("record is not null and size(each) > 0").select("record", of.alias("v"), F.xxhash64(of).alias("h"), F.hash(of).alias("g"), F.size("each").alias("n"))
    key = ["h", "g", "n"]
    classes = stash.put(keyed.groupBy(*key).agg(F.min("record").alias("class_no"), F.first("v").alias("v")).select("class_no", "v"))
    named = classes.select("class_no", F.xxhash64("v").alias("h"), F.hash("v").alias("g"), F.size("v").alias("n"))
    members = stash.put(keyed.select("record", *key).join(named, key).select("record", "class_no").distinct())
    stash.drop(sets)
    out = classes.select("class_no", F.col("v").alias("values"))
    out._stash_rows = stash.rows(classes)
    return members, out


def similar_classes(spark: SparkSession, stash: Stash, classes: DataFrame, num: int, den: int) -> DataFrame:
    """class_a, class_b, overlap: pairs of classes with a Jaccard index of at least num / den, class_a < class_b."""
    held = classes.select("class_no", F.size("values").alias("n"), F.explode("values").alias("value"))
    # ids in order of rarity, unique and ordered; a value of one class alone is shared with none and only counts towards the size
    shared = held.groupBy("value").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").orderBy("m", "value")
    shared = stash.put(shared.select("value", "m", F.monotonically_increasing_id().alias("id")))
    hot_from = shared.filter(F.col("m") > BLOCK).agg(F.min("id")).first()[0]
    coded = held.join(shared.select("value", "id"), "value").groupBy("class_no", "n").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    least = F.floor((F.col("n") * num + (den - 1)) / den).cast("int")
    # of the rarest n - least + 1 values those without id come first and need no partition
    prefix = F.greatest(F.size("ids") - least + 1, F.lit(0))
    spread = coded.select("class_no", "n", "ids", F.explode(F.slice("ids", F.lit(1), prefix)).alias("value"))
    whole = [F.lit(0).alias("b1"), F.lit(0).alias("b2"), "class_no", F.lit(False).alias("second"), "ids", "n"]
    if hot_from is None:  # no value has more classes than a block holds
        parts = spread.select("value", *whole)
    else:
        hot = spread.filter(F.col("value") >= hot_from)
        counts = hot.groupBy("value").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        mine = F.pmod(F.xxhash64("class_no"), F.col("blocks")).cast("int")
        placed = hot.join(counts, "value").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cut = placed.select("value", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), "class_no", (F.col("mine") > F.col("other")).alias("second"), "ids", "n")
        parts = spread.filter(F.col("value") < hot_from).select("value", *whole).unionByName(cut)
    ordered = parts.repartition(tasks_for(spark, getattr(classes, "_stash_rows", 0), CLASSES_A_TASK), "value", "b1", "b2").sortWithinPartitions("value", "b1", "b2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        members: list[tuple] = []
        out: list[tuple[int, int, int]] = []

        def flush() -> None:
            if len(members) > 1:
                out.extend(_pairs_of(key[0], key[1] != key[2], members, num, den))
            members.clear()

        def table() -> pa.RecordBatch:
            a, b, o = zip(*out) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(o, pa.int32())], names=["class_a", "class_b", "overlap"])

        for batch in batches:
            for *group, cls, second, ids, n in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if group != key:
                    flush()
                    key = group
                members.append((cls, second, ids, n))
            yield table()
        flush()
        yield table()

    return ordered.mapInArrow(run, "class_a bigint, class_b bigint, overlap int")


def similar_records(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """record_a < record_b: the pairs of classes, and the copies within a class, as pairs of records."""
    a, b = (members.select(F.col("record").alias(f"r{x}"), F.col("class_no").alias(f"class_{x}")) for x in "ab")
    across = pairs.join(a, "class_a").join(b, "class_b").select("ra", "rb")
    copies = a.join(b.withColumnRenamed("class_b", "class_a"), "class_a").filter("ra < rb").select("ra", "rb")
    return across.unionByName(copies).select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b"))


def class_links(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """record, class_no, links: how many records each is similar to, itself left out, without making a pair of copies."""
    sizes = members.groupBy("class_no").agg(F.count(F.lit(1)).alias("size"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("class_a").alias("class_no"), F.col("class_b").alias("other")), F.struct(F.col("class_b").alias("class_no"), F.col("class_a").alias("other")))).alias("e")).select("e.*")
    far = ends.join(sizes.withColumnRenamed("class_no", "other"), "other").groupBy("class_no").agg(F.sum("size").alias("far"))
    links = sizes.join(far, "class_no", "left").select("class_no", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    return members.join(links, "class_no").select("record", "class_no", "links")
