"""Consensus from several annotators' labels by latent ability and difficulty, learned by gradient expectation-maximisation.

Annotator j labels item i rightly with probability s(a_j b_i - log(K_i - 1)), s the logistic function, a_j the annotator's
ability and b_i > 0 the item's ease; a wrong label is any of the K_i - 1 others alike. Ability 0 is guessing, and a vote adds
a_j b_i to the log posterior of its label, whose prior is the label's share of the votes in the item's context. Each pass over the votes, sorted by item, takes the posterior of each item's labels (E), moves the
item's ease along its gradient until it settles (that needs the item's votes alone, so no state per item is kept
between passes), and sums gradient and curvature of the abilities per annotator, combined per batch before the shuffle (M).
Abilities are a table of one row per annotator; below a checked number of annotators it is broadcast, beyond that
the votes are joined with it by shuffle and sorted again. An item that very many annotators label is read as a histogram of
abilities for each label, combined before the shuffle, and its posterior is joined back to the votes.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegraph.session import Stash, tasks_for

BROADCAST_ANNOTATORS = 100_000
VOTES_A_TASK = 1_000_000
#: An item of more votes isn't held in one task: its votes are combined by label and ability, the latter rounded to so many digits.
HOT_VOTES, DIGITS = 1_000_000, 3
#: The learning ends when no ability moves by SETTLED any more, and says so if it hasn't after PASSES.
PASSES, SETTLED = 25, 0.01
#: Priors: abilities are normal around 3, logarithms of ease around 0.
ABILITY_MEAN, ABILITY_VAR, EASE_VAR = 3.0, 4.0, 0.1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins."""
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


class Items:
    """The votes of whole items, sorted by item and label, and what follows from them given the abilities."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, label: np.ndarray, ability: np.ndarray, choices: np.ndarray, share: np.ndarray, weight: np.ndarray, square: np.ndarray):
        n = len(h1)
        self.item_at = _starts(h1, h2)
        self.label_at = _starts(h1, h2, label)
        self.item = np.repeat(np.arange(len(self.item_at)), np.diff(np.append(self.item_at, n)))
        self.label = np.repeat(np.arange(len(self.label_at)), np.diff(np.append(self.label_at, n)))
        self.label_item = self.item[self.label_at]
        self.ability = ability
        self.weight, self.square = weight, square  # of a row of several votes the sums of weights and of their squares
        self.support = np.add.reduceat(weight, self.label_at)
        self.share = share[self.label_at]
        self.sums = np.add.reduceat(weight * ability, self.label_at)
        voted = np.bincount(self.label_item)
        self.k = np.maximum(np.maximum(choices[self.item_at], voted), 2)
        self.first_label = _starts(self.label_item)
        self.unvoted = np.maximum(1 - np.add.reduceat(self.share, self.first_label), 0)
        self.chance = np.log(self.k - 1)[self.item]
        self.log_ease = np.zeros(len(self.item_at))
        for _ in range(8):
            p, s = self.posterior(), self.right()
            ab = self.ability * np.exp(self.log_ease)[self.item]
            up = np.add.reduceat(weight * (p[self.label] - s) * ab, self.item_at) - self.log_ease / EASE_VAR
            bend = np.add.reduceat(weight * s * (1 - s) * ab * ab, self.item_at) + 1 / EASE_VAR
            self.log_ease = np.clip(self.log_ease + np.clip(up / bend, -0.5, 0.5), -3, 3)

    def right(self) -> np.ndarray:
        """Probability that each vote is right, before looking at the other votes."""
        return _sigmoid(self.ability * np.exp(self.log_ease)[self.item] - self.chance)

    def posterior(self) -> np.ndarray:
        """Of each voted label."""
        z = np.exp(self.log_ease)[self.label_item] * self.sums + np.log(self.share)
        top = np.maximum(np.maximum.reduceat(z, self.first_label), 0)
        e = np.exp(z - top[self.label_item])
        return e / (np.add.reduceat(e, self.first_label) + self.unvoted * np.exp(-top))[self.label_item]


def _whole_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches regrouped so that no item is cut; a new item begins where h1 or h2 changes. An annotator's votes on an item weigh one together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
        starts = _starts(h1, h2)
        if held and (held[-1].column("h1")[-1].as_py(), held[-1].column("h2")[-1].as_py()) != (h1[0], h2[0]):
            yield pa.Table.from_batches(held)
            held = []
        cut = starts[-1]
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _items(t: pa.Table) -> Items:
    weight = t.column("weight").to_numpy()
    square = t.column("square").to_numpy() if "square" in t.column_names else weight**2
    return Items(*(t.column(c).to_numpy() for c in ("h1", "h2", "label_hash", "ability", "choices", "share")), weight, square)


def _gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole_items(batches):
        x = _items(t)
        ease, s = np.exp(x.log_ease)[x.item], x.right()
        who, of = np.unique(t.column("code").to_numpy(), return_inverse=True)
        up = np.bincount(of, x.weight * (x.posterior()[x.label] - s) * ease)
        bend = np.bincount(of, x.weight * s * (1 - s) * ease * ease)
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(up), pa.array(bend)], names=["code", "up", "bend"])


def _posteriors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each label of an item its probability, and the item's ease and chance."""
    for t in _whole_items(batches):
        x = _items(t)
        at = pa.array(x.label_at)
        rest = [x.posterior(), np.exp(x.log_ease)[x.label_item], x.chance[x.label_at]]
        yield pa.RecordBatch.from_arrays([*(t.column(c).take(at).combine_chunks() for c in ("h1", "h2", "label_hash")), *map(pa.array, rest)], names=["h1", "h2", "label_hash", "p", "ease", "chance"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole_items(batches):
        x = _items(t)
        p = x.posterior()
        order = np.lexsort((np.arange(len(p)), -p, x.label_item))  # of equal posteriors the label of smaller hash
        best = order[_starts(x.label_item[order])]
        votes = np.rint(np.bincount(x.item, x.weight)).astype(np.int64)  # annotators
        same = np.add.reduceat(x.support**2 - np.add.reduceat(x.square, x.label_at), x.first_label)
        observed = np.where(votes > 1, same / np.maximum(votes * (votes - 1), 1), np.nan)
        at = pa.array(x.label_at[best])
        columns = [t.column(c).take(at).combine_chunks() for c in ("item", "label")]
        rest = [p[best], votes, np.bincount(x.label_item), np.exp(-x.log_ease), observed]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, from_pandas=True) for c in rest)], names=["item", "label", "confidence", "votes", "labels", "difficulty", "observed"])


class Consensus(NamedTuple):
    items: DataFrame
    annotators: DataFrame
    passes: int  # made over the votes
    step: float  # the largest of the last pass, in ability


def consensus(spark: SparkSession, votes: DataFrame, item: list[str], annotator: str, label: str, context: list[str], passes: int = PASSES, settled: float = SETTLED) -> Consensus:
    """items and annotators from votes, one row per item, annotator and label.

    items: the item's columns, label (of the highest posterior), confidence (that posterior), votes (annotators), labels (distinct
    ones voted), difficulty, agreement: of the pairs of annotators the share that agree, corrected for chance by the shares of labels over all
    votes, null for a single one. annotators: annotator, votes (items), ability, reliability (probability of a right label on an item
    of average ease among as many labels as contexts have on average). The labels to choose from are those voted in the item's context.
    Rows with a null in any of these columns are no votes; an annotator's several labels of one item are votes of equal shares, one
    together; repeats count once. No votes give empty tables. It warns if abilities still move by `settled` or more after `passes`."""
    stash = Stash(spark)
    v = votes.select(F.struct(*item).alias("item"), F.struct(*context).alias("context"), F.col(annotator).alias("annotator"), F.col(label).alias("label")).dropna()
    for c in item:
        v = v.filter(F.col(f"item.{c}").isNotNull())
    given = v.groupBy("item", "annotator").agg(F.collect_set("label").alias("labels"), F.min("context").alias("context"))
    single = stash.put(given.select("item", "annotator", "context", (1 / F.size("labels")).alias("weight"), F.explode("labels").alias("label")))
    in_context = single.groupBy("context", "label").agg(F.sum("weight").alias("n"))
    contexts = in_context.groupBy("context").agg(F.count(F.lit(1)).alias("choices"), F.sum("n").alias("all"))
    shares = in_context.join(contexts, "context").select("context", "label", "choices", (F.col("n") / F.col("all")).alias("share"))
    codes = stash.put(single.groupBy("annotator").agg(F.round(F.sum("weight")).cast("bigint").alias("votes")).withColumn("code", F.monotonically_increasing_id()))
    coded = single.join(shares, ["context", "label"]).join(codes.select("annotator", "code"), "annotator")
    coded = coded.select(F.xxhash64("item").alias("h1"), F.xxhash64(F.lit(1), "item").alias("h2"), F.xxhash64("label").alias("label_hash"), "code", "choices", "share", "weight", "item", "label")
    order = ("h1", "h2", "label_hash")
    few = stash.rows(codes) <= BROADCAST_ANNOTATORS
    width = tasks_for(spark, stash.rows(single), VOTES_A_TASK)
    # kept as it is partitioned, so that no item is cut; what an executor loses is computed again
    hot = None
    if stash.rows(codes) > HOT_VOTES:  # no item has more votes of one label than there are annotators
        many = stash.put(coded.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_VOTES).select("h1", "h2"))
        if stash.rows(many):
            hot = stash.put(coded.join(many, ["h1", "h2"], "left_semi"))
            coded = coded.join(many, ["h1", "h2"], "left_anti")
    table = coded.repartition(width, "h1", "h2").sortWithinPartitions(*order).persist()

    def with_ability(of: DataFrame, columns: list[str]) -> DataFrame:
        df = table.select(*columns)
        if few:  # a join with a broadcast table leaves rows where they are
            return df.join(F.broadcast(of), "code").select(*columns, "ability")
        return df.join(of, "code").repartition(width, "h1", "h2").sortWithinPartitions(*order).select(*columns, "ability")

    def histogram(of: DataFrame) -> DataFrame:
        """The votes of hot items by label and ability; an item has as many rows as these have values."""
        same = F.round("ability", DIGITS).alias("ability")
        rows = hot.join(of, "code").groupBy("h1", "h2", "label_hash", same).agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("weight")).alias("square"), F.max("choices").alias("choices"), F.max("share").alias("share"), F.min("item").alias("item"), F.min("label").alias("label"))
        return rows.repartition(width, "h1", "h2").sortWithinPartitions(*order)

    def hot_gradients(of: DataFrame) -> DataFrame:
        known = histogram(of).drop("item", "label").mapInArrow(_posteriors, "h1 bigint, h2 bigint, label_hash bigint, p double, ease double, chance double")
        right = 1 / (1 + F.exp(F.col("chance") - F.col("ability") * F.col("ease")))
        votes = hot.join(of, "code").join(known, list(order)).withColumn("s", right)
        return votes.select("code", (F.col("weight") * (F.col("p") - F.col("s")) * F.col("ease")).alias("up"), (F.col("weight") * F.col("s") * (1 - F.col("s")) * F.col("ease") * F.col("ease")).alias("bend"))

    ability = now = stash.put(codes.select("code", F.lit(ABILITY_MEAN).alias("ability")))
    made, far = 0, None
    while made < passes:
        made += 1
        ability = ability.select("code", "ability")
        each = with_ability(ability, ["h1", "h2", "label_hash", "code", "choices", "share", "weight"]).mapInArrow(_gradients, "code bigint, up double, bend double")
        if hot is not None:
            each = each.unionByName(hot_gradients(ability))
        sums = each.groupBy("code").agg(F.sum("up").alias("up"), F.sum("bend").alias("bend"))
        up = F.col("up") - (F.col("ability") - ABILITY_MEAN) / ABILITY_VAR
        step = F.greatest(F.least(up / (F.col("bend") + 1 / ABILITY_VAR), F.lit(1.0)), F.lit(-1.0))
        moved, far = stash.put_with(ability.join(sums, "code").select("code", (F.col("ability") + step).alias("ability"), F.abs(step).alias("by")), F.max("by").alias("far"))
        stash.drop(now)
        ability = now = moved
        if far is None or far < settled:
            break
    else:
        warnings.warn(f"abilities still move by {far:.3g} after {passes} passes over the votes", stacklevel=2)
    ability = ability.select("code", "ability")
    kinds = {c: single.schema[c].dataType.simpleString() for c in ("item", "label")}
    decision = f"item {kinds['item']}, label {kinds['label']}, confidence double, votes bigint, labels bigint, difficulty double, observed double"
    decided = with_ability(ability, table.columns).mapInArrow(_decide, decision)
    if hot is not None:
        decided = decided.unionByName(histogram(ability).mapInArrow(_decide, decision))
    total = single.agg(F.sum("weight")).first()[0] or 1.0
    chance = single.groupBy("label").agg((F.sum("weight") / F.lit(total)).alias("p")).agg(F.sum(F.col("p") * F.col("p"))).first()[0] or 0.0
    agreement = (F.col("observed") - chance) / (1 - chance) if chance < 1 else F.lit(1.0)
    decided = stash.put(decided)
    table.unpersist()
    items = decided.select("item.*", "label", "confidence", "votes", "labels", "difficulty", agreement.alias("agreement"))
    guess = contexts.agg(F.sum(F.log(F.greatest(F.col("choices"), F.lit(2)) - 1) * F.col("all")) / F.sum("all")).first()[0] or 0.0
    annotators = codes.join(ability, "code").select("annotator", "votes", "ability", (1 / (1 + F.exp(guess - F.col("ability")))).alias("reliability"))
    return Consensus(items, annotators, made, far or 0.0)
