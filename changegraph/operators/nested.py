"""Deeply nested records as flat tables that keep parent and child together.

Every node of a record (object, array, scalar) gets a pre-order and a post-order number by one depth-first
traversal; a node lies below another exactly if its pre-order number is larger and its post-order number
smaller. The caller names the node types it wants by path patterns; one table of labelled nodes comes out,
of which each type is a slice, and types are linked by containment of these intervals.

The traversal is the one part in Python: the layout of a record is known only once it has been read. Links
are made in the JVM by a structural join: the nodes of a record, sorted by pre-order number, are passed once,
and the last candidate that is still open is the parent. Where nodes of a type may lie in others of their type, their
nesting levels are counted first, as a node at depth d covers the pre-order numbers up to its post-order number plus d.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = [("node_type", pa.string()), ("pre", pa.int32()), ("post", pa.int32()), ("depth", pa.int32()), ("name", pa.string()), ("value", pa.string())]
NODES = "node_type string, pre int, post int, depth int, name string, value string"


@dataclass(frozen=True)
class NodeType:
    """Nodes at `path` (keys, `*` for any key or index) become rows of type `kind`.

    name: the first of these fields that the object has, else the key it is filed under. value: of a scalar the scalar
    itself, of an object the first of these fields. holds: whether objects, scalars or both are such nodes."""

    kind: str
    path: tuple[str, ...]
    name: tuple[str, ...] = ()
    value: tuple[str, ...] = ()
    holds: str = "any"


def trie(types: list[NodeType]) -> dict:
    root: dict = {}
    for t in types:
        at = root
        for key in t.path:
            at = at.setdefault(key, {})
        at[None] = t
    return root


_BLANK = re.compile(r"[ \t\n\r]*")
_ATOM = json.JSONDecoder()


def _parsed(text: str) -> Any:
    """A JSON text of any depth, with a stack of the containers that are open instead of recursion. ValueError if it isn't complete JSON."""
    open_: list[tuple[Any, str | None]] = []  # container, and the key its next value goes to
    at = _BLANK.match(text, 0).end()

    def next_at(i: int) -> tuple[str, int]:
        i = _BLANK.match(text, i).end()
        if i >= len(text):
            raise ValueError("cut off")
        return text[i], i

    def key_at(i: int) -> tuple[str, int]:
        c, i = next_at(i)
        if c != '"':
            raise ValueError("no key")
        key, i = json.decoder.scanstring(text, i + 1)
        c, i = next_at(i)
        if c != ":":
            raise ValueError("no value")
        return key, i + 1

    while True:
        c, at = next_at(at)
        if c in "{[":
            value: Any = {} if c == "{" else []
            after, i = next_at(at + 1)
            if after != ("}" if c == "{" else "]"):
                key, at = key_at(at + 1) if c == "{" else (None, at + 1)
                open_.append((value, key))
                continue
            at = i + 1
        else:
            value, at = _ATOM.raw_decode(text, at)
        while True:  # the value is complete: into its container, which may be complete with it
            if not open_:
                if _BLANK.match(text, at).end() != len(text):
                    raise ValueError("something behind the end")
                return value
            holder, key = open_.pop()
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            c, at = next_at(at)
            if c == ",":
                key, at = key_at(at + 1) if isinstance(holder, dict) else (None, at + 1)
                open_.append((holder, key))
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError("no end")
            value, at = holder, at + 1


def parse(text: Any) -> Any:
    """The record in a JSON text, also where the text was encoded several times over; None if it isn't complete JSON."""
    while isinstance(text, str):  # every decoding makes the text shorter
        try:
            text = json.loads(text)
        except RecursionError:
            try:
                text = _parsed(text)
            except ValueError:
                return None
        except ValueError:
            return None
    return text


def _written(node: Any) -> str | None:
    """A value as text: a string as it is, others as JSON; None for one that is nested too deep to be written."""
    try:
        return node if isinstance(node, str) else json.dumps(node)
    except RecursionError:
        return None


def _first(node: dict, fields: tuple[str, ...]) -> str | None:
    return next((_written(node[f]) for f in fields if node.get(f) is not None), None)


def label(record: Any, wanted: dict) -> list[list]:
    """[type, pre, post, depth, name, value] of the nodes wanted, in pre-order; all nodes of the record are numbered.

    A stack instead of recursion: depth is bounded by memory. Null nodes are numbered and never wanted."""
    out: list[list] = []
    pre = post = 0
    stack: list[tuple] = [(record, wanted, 0, None)]
    while stack:
        node, at, depth, key = stack.pop()
        if depth < 0:  # the way back up
            if node is not None:
                node[2] = post
            post += 1
            continue
        row = None
        if at and None in at and node is not None:
            t = at[None]
            inner = isinstance(node, (dict, list))
            if t.holds == "any" or (t.holds == "object") == inner:
                if isinstance(node, dict):
                    name, value = _first(node, t.name) or key, _first(node, t.value)
                else:
                    name, value = key, None if inner else _written(node)
                row = [t.kind, pre, 0, depth, name, value]
                out.append(row)
        pre += 1
        if isinstance(node, dict):
            stack.append((row, None, -1, None))
            stack.extend([(v, (at.get(k) or at.get("*")) if at else None, depth + 1, k) for k, v in reversed(node.items())])
        elif isinstance(node, list):
            stack.append((row, None, -1, None))
            below = at.get("*") if at else None
            stack.extend([(v, below, depth + 1, None) for v in reversed(node)])
        else:
            if row is not None:
                row[2] = post
            post += 1
    return out


def node_table(df: DataFrame, keys: list[str], record: str, types: list[NodeType]) -> DataFrame:
    """The labelled nodes of each row's record: keys, record_hash, node_type, pre, post, depth, name, value.

    record is a column of JSON text or of any nested type. Rows whose record is null, empty or not complete JSON give
    no nodes; other columns of df aren't read. record_hash tells records apart that share their keys; rows that are
    repeated give the same nodes again."""
    key_fields = [df.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields) + ", record_hash bigint, " + NODES
    wanted, width = trie(types), len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, columns = [], [[] for _ in COLUMNS]
            for i, x in enumerate(batch.column(width)):
                x = parse(x.as_py())
                if x is None:
                    continue
                rows = label(x, wanted)
                source.extend([i] * len(rows))
                for c, values in zip(columns, zip(*rows)):
                    c.extend(values)
            take = pa.array(source, pa.int64())
            arrays = [batch.column(i).take(take) for i in range(width)] + [pa.array(c, t) for c, (_, t) in zip(columns, COLUMNS)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "record_hash", *(n for n, _ in COLUMNS)])

    return df.select(*keys, F.xxhash64(record).alias("record_hash"), F.col(record).alias("_record")).filter("_record is not null").mapInArrow(run, schema)


def rejected(df: DataFrame, keys: list[str], record: str) -> DataFrame:
    """keys, reason: the rows of df whose record gives no nodes: it is null, blank, or not complete JSON."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", reason string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = ["null" if x is None else "blank" if isinstance(x, str) and not x.strip() else "not complete JSON" if parse(x) is None else None for x in batch.column(len(keys)).to_pylist()]
            bad = pa.array([i for i, r in enumerate(reasons) if r], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(bad) for i in range(len(keys))), pa.array([r for r in reasons if r], pa.string())], names=[*keys, "reason"])

    return df.select(*keys, F.col(record).alias("_record")).mapInArrow(run, schema)


def nesting(types: list[NodeType]) -> set[str]:
    """The kinds whose nodes may lie in nodes of the same kind."""
    fits = lambda p, q: all(x == y or "*" in (x, y) for x, y in zip(p, q))
    return {t.kind for t in types for u in types if t.kind == u.kind and len(t.path) < len(u.path) and fits(t.path, u.path)}


def _last_open(df: DataFrame, by: list[str], kind: str, this: Column) -> DataFrame:
    """df with `_in_<kind>`: the innermost node of the kind that a row lies in, where such nodes may lie in each other."""
    mine = F.col("node_type") == kind
    marked = df.withColumn("_at", F.col("pre")).withColumn("_end", F.lit(0)).withColumn("_step", F.when(mine, 1).otherwise(0))
    ends = df.filter(mine).withColumn("_at", F.col("post") + F.col("depth")).withColumn("_end", F.lit(1)).withColumn("_step", F.lit(-1))
    levels = marked.unionByName(ends).withColumn("_level", F.sum("_step").over(Window.partitionBy(*by).orderBy("_at", "_end").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    w = Window.partitionBy(*by, "_level").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return levels.filter("_end = 0").withColumn(f"_in_{kind}", F.last(F.when(mine, this), ignorenulls=True).over(w)).drop("_at", "_end", "_step", "_level")


def link(nodes: DataFrame, keys: list[str], chain: list[str], nests: set[str] = frozenset()) -> DataFrame:
    """Parents and their children: keys, record_hash, for each type of chain `<type>_pre`, `<type>_name` and `<type>_value`.

    chain goes from the outermost type to the innermost; nests are the types that may lie in nodes of their own type (`nesting`), of
    which the innermost is the parent. A node of the last type but one that contains none of the last gives one row with nulls; a
    node outside all of its outer type is left out. One shuffle by record; a record's nodes came out of one row, so they fit in a task."""
    outer, parent, child = chain[:-1], chain[-2], chain[-1]
    by = [*keys, "record_hash"]
    w = Window.partitionBy(*by).orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    this = F.struct("pre", "post", "name", "value")
    df = nodes.filter(F.col("node_type").isin(chain))
    if nests:
        df = df.distinct()  # a repeated record's nodes would count as nested ones
    df = df.select("*", *[F.last(F.when(F.col("node_type") == t, this), ignorenulls=True).over(w).alias(f"_in_{t}") for t in outer if t not in nests])
    for t in outer:
        if t in nests:
            df = _last_open(df, by, t, this)
    inside = F.lit(True)
    for t, below in zip(outer, [*outer[1:], None]):
        lower = F.col(f"_in_{below}") if below else this
        held = (F.col(f"_in_{t}.pre") < lower["pre"]) & (F.col(f"_in_{t}.post") > lower["post"])
        inside &= F.when(F.col("node_type") == parent, held if below else F.lit(True)).otherwise(held)
    kept = df.filter(F.col("node_type").isin(parent, child) & inside)
    names = [F.col(f"_in_{t}.{c}").alias(f"{t}_{c}") for t in outer for c in ("pre", "name", "value")]
    grouped = kept.select(*by, *names, F.when(F.col("node_type") == child, this).alias("_child")).groupBy(*by, *[f"{t}_{c}" for t in outer for c in ("pre", "name", "value")])
    rows = grouped.agg(F.collect_list("_child").alias("_children")).withColumn("_child", F.explode_outer("_children"))
    return rows.select(*by, *[f"{t}_{c}" for t in outer for c in ("pre", "name", "value")], *[F.col(f"_child.{c}").alias(f"{child}_{c}") for c in ("pre", "name", "value")])
