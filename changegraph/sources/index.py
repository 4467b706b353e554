"""A symbol index that an indexer left behind, as the call graph of files that no parser here reads.

The index is three tables: nodes(id, kind, name, qualified_name, file_path, start_line, end_line, signature, docstring),
edges(source, target, kind), files(path, errors). They may be DataFrames of any source; for a SQLite file there is a data source:

    spark.dataSource.register(SqliteTable)
    spark.read.format("sqlitetable").schema(NODES).option("path", path).option("table", "nodes").load()
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from changegraph.parse.graph_of import Index

NODES = "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, signature string, docstring string"
EDGES = "source string, target string, kind string"
FILES = "path string, errors string"
#: Kinds of nodes that are definitions, of edges that are calls, of edges that are bases, and names of constructors.
DEFINITIONS = ("function", "method", "constructor", "class", "struct", "module", "component", "trait")
CALLS = ("calls", "instantiates", "references")
BASES = ("extends", "implements")
CONSTRUCTORS = ("constructor", "initialize", "__init__", "init", "new")


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.each = options["path"], options["table"], int(options.get("rowsPerTask", "500000"))
        self.names = schema.fieldNames()
        if not self.table.isidentifier():
            raise ValueError(f"no such table: {self.table}")

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        db = self._open()
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        db.close()
        return [Rows(k, k + self.each - 1) for k in range(low, high + 1, self.each)] if low is not None else [Rows(1, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        db = self._open()
        columns = ", ".join(f'"{n}"' for n in self.names)
        for row in db.execute(f"SELECT {columns} FROM {self.table} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last)):
            yield tuple(None if v is None else str(v) if n not in ("start_line", "end_line") else int(v) for n, v in zip(self.names, row))
        db.close()


class SqliteTable(DataSource):
    """A table of a SQLite file that all workers see at the same path, read in slices of row numbers."""

    @classmethod
    def name(cls) -> str:
        return "sqlitetable"

    def schema(self) -> str:
        return {"nodes": NODES, "edges": EDGES, "files": FILES}[self.options["table"]]

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


def read_sqlite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, files) of a SQLite index."""
    spark.dataSource.register(SqliteTable)
    return tuple(spark.read.format("sqlitetable").option("path", path).option("table", t).load() for t in ("nodes", "edges", "files"))


def definitions(nodes: DataFrame) -> DataFrame:
    """id, kind, short, path, name, start, end, node, signature, doc of the nodes that define something."""
    d = nodes.filter(F.col("kind").isin(*DEFINITIONS))
    name = F.replace("qualified_name", F.lit("::"), F.lit("."))
    inner = F.col("signature").rlike(r"^\(.*\)$")
    told = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(F.trim("docstring"), r"(?s)^(.*?)(?:\n\s*\n|$)", 1), r"\s+", " ")), F.lit(""))
    return d.select("id", "kind", F.col("name").alias("short"), F.col("file_path").alias("path"), name.alias("name"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.concat_ws(":", "file_path", name).alias("node"), F.when(inner, F.expr("substring(signature, 2, length(signature) - 2)")).otherwise(F.col("signature")).alias("signature"), told.alias("doc"))


def calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst: calls between definitions; who makes an object of a class runs its constructor, so a class calls the constructor it contains."""
    d = definitions(nodes)
    src, dst = d.select(F.col("id").alias("source"), F.col("node").alias("src")), d.select(F.col("id").alias("target"), F.col("node").alias("dst"), "short")
    met = edges.join(src, "source").join(dst, "target")
    return met.filter(F.col("kind").isin(*CALLS) | ((F.col("kind") == "contains") & F.col("short").isin(*CONSTRUCTORS))).filter("src <> dst").select("src", "dst").distinct()


def bases(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, base: the names of what each class extends or implements."""
    d = definitions(nodes)
    met = edges.filter(F.col("kind").isin(*BASES)).join(d.select(F.col("id").alias("source"), "node"), "source").join(d.select(F.col("id").alias("target"), F.col("short").alias("base")), "target")
    return met.select("node", "base").distinct()


def index_of(ref: str, nodes: DataFrame, edges: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".rb")) -> Index:
    """The index of one revision, for the call graph. Files with errors count as unparsed."""
    at = F.lit(ref).alias("ref")
    bad = files.filter(F.coalesce(F.trim("errors"), F.lit("")).isin("", "[]", "null") == F.lit(False))
    return Index(definitions(nodes).select(at, "path", "name", "start", "end"), calls(nodes, edges).select(at, "src", "dst"), bad.select(at, "path"), suffixes)


