"""Items of varying length put into containers of fixed capacity: minimum bin slack on the lengths.

An item longer than the capacity is cut into full pieces and a rest. Containers depend on lengths alone, so the data is
reduced to the number of items of each length, at most `capacity` rows. On these, per container: the longest length that is left
is taken, and a subset-sum over the lengths available, one bit per sum, finds the fullest combination that fits beside it. The
combination is then removed as often as its lengths are there, so there are about as many combinations as lengths,
however many items. Items are then numbered within their length, by bucket with the buckets' offsets, so
that a length which a third of all items have is no one task's work, and look up their container by that number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changegraph.session import Stash, tasks_for


PIECES_A_BUCKET = 1_000_000
#: Bits for the number of an item within its length; the rest is for the length.
WIDTH = 40


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """length -> copies, at most those available: the combination with the largest sum up to room.

    Bit s of `sums` says that the lengths looked at so far have a combination of sum s. Copies are offered in packets of 1, 2, 4, ...
    so that k copies take log2(k) shifts; longer lengths first, and none once the room is filled to the last unit."""
    mask, full = (1 << (room + 1)) - 1, 1 << room
    sums, packets = 1, []
    for length in sorted((x for x in available if x <= room), reverse=True):
        copies, size = min(available[length], room // length), 1
        while copies > 0 and not sums & full:
            take = min(size, copies)
            packets.append((sums, length, take))
            sums |= (sums << (length * take)) & mask
            copies, size = copies - take, size * 2
        if sums & full:
            break
    left, chosen = sums.bit_length() - 1, {}
    for before, length, take in reversed(packets):
        if not before >> left & 1:
            chosen[length] = chosen.get(length, 0) + take
            left -= length * take
    return chosen


@dataclass
class Plan:
    """Rows sorted by length and start: items start, start + 1, ... of a length go `each` to a container, from `first` on, to the places after `place`."""

    length: np.ndarray
    start: np.ndarray
    each: np.ndarray
    first: np.ndarray
    place: np.ndarray
    containers: int

    def assign(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Container and position of items given by length and number within the length."""
        at = np.searchsorted((self.length << WIDTH) + self.start, (length << WIDTH) + number, "right") - 1
        past = number - self.start[at]
        return self.first[at] + past // self.each[at], self.place[at] + past % self.each[at]


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    left = dict(histogram)
    used = dict.fromkeys(left, 0)
    rows, containers = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest({k: n for k, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        place = 0
        for k in sorted(chosen, reverse=True):
            rows.append((k, used[k], chosen[k], containers, place))
            place += chosen[k]
            used[k] += chosen[k] * times
            left[k] -= chosen[k] * times
            if not left[k]:
                del left[k]
        containers += times
    rows.sort()
    columns = [np.array(c, np.int64) for c in (zip(*rows) if rows else [()] * 5)]
    return Plan(*columns, containers)


def pack(spark: SparkSession, sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """key, piece_no, start, length, container, position: one row per item or piece of one, start and length in units of size.

    Items of size null, 0 or less take no room: one row with length 0 and no container. key need not be unique; rows that come
    twice are two items. Containers are numbered from 0, positions in a container from 0."""
    if not 0 < capacity < 1 << 22:
        raise ValueError("the capacity must be positive and below 2^22")
    stash = Stash(spark)
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    cut = sizes.select(F.col(key).alias("k"), n.alias("n")).select("k", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((F.col("n") - 1) / capacity), F.lit(0)))).alias("piece_no"))
    pieces = stash.put(cut.select("k", "piece_no", (F.col("piece_no") * capacity).alias("start"), F.least(F.col("n") - F.col("piece_no") * capacity, F.lit(capacity)).cast("bigint").alias("length")))
    some = pieces.filter("length > 0")
    lengths = some.groupBy("length").agg(F.count(F.lit(1)).alias("n"))  # at most `capacity` rows
    chosen = plan({r["length"]: r["n"] for r in lengths.collect()}, capacity)

    buckets = tasks_for(spark, stash.rows(pieces), PIECES_A_BUCKET)
    placed = some.withColumn("bucket", F.pmod(F.xxhash64("k", "piece_no"), F.lit(buckets)))
    ranked = placed.withColumn("nth", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("k", "piece_no")) - 1)
    ahead = placed.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("m"))
    offsets = ahead.select("bucket", "length", (F.sum("m").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")).alias("offset"))
    numbered = ranked.join(offsets, ["bucket", "length"]).select("k", "piece_no", "start", "length", (F.col("offset") + F.col("nth")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            container, position = chosen.assign(batch.column(3).to_numpy(), batch.column(4).to_numpy()) if batch.num_rows else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(container), pa.array(position)], names=["k", "piece_no", "start", "length", "container", "position"])

    kind = sizes.schema[key].dataType.simpleString()
    packed = numbered.mapInArrow(run, f"k {kind}, piece_no bigint, start bigint, length bigint, container bigint, position bigint")
    none = pieces.filter("length = 0").select("k", "piece_no", "start", "length", F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("bigint").alias("position"))
    return packed.unionByName(none).withColumnRenamed("k", key)
