"""What the analysis of a change can't see: nine rules, any of which keeps it from saying that the change is contained."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegraph.functions import paths

#: Directories whose files change the schema of stored data.
MIGRATION_DIRS = ("alembic", "migrate", "migration", "migrations")
RULES = (
    "changed file can't be parsed",
    "other file can't be parsed",
    "inventory failed",
    "migration",
    "module-level change",
    "class body without reach",
    "code without call graph",
    "outside of the analysis",
    "entry point gone, handler still there",
)


def in_directory(path: Column, names: tuple[str, ...]) -> Column:
    """Whether one of the directories above the file bears one of the names."""
    above = F.split(path, "/")
    return F.arrays_overlap(F.slice(above, 1, F.greatest(F.size(above) - 1, F.lit(0))), F.array(*map(F.lit, names)))


def blind_spots(by: list[str], files: DataFrame, unparsed: DataFrame, failed: DataFrame, symbols: DataFrame, reached: DataFrame, base: DataFrame, head: DataFrame, defs: DataFrame, migrates: Column | None = None) -> DataFrame:
    """by, rule, subject. `by` are the columns that tell changes apart, none for a single one; all tables have them.

    files: path, kind (code, test, generated, doc, outside), graphed, the files that changed; unparsed: path, on either side; failed: subject,
    revisions whose entry points couldn't be listed; symbols: path, name, status, those that changed and not only in looks; reached: path,
    name, the symbols that some entry point reaches; base, head: endpoint, handler; defs: node, of head.

    migrates: of a file's path, whether it changes the schema of stored data; by default by its directory. Tests and documents don't blind. New symbols inherit their callers' reach, so a new class is none whose fields nobody follows."""
    key = [*by, "path"]
    code = files.filter("kind = 'code'")
    moved = code.filter(in_directory(F.col("path"), MIGRATION_DIRS) if migrates is None else migrates)
    bad = unparsed.select(*key).distinct()
    module = symbols.filter("name = '<module>'").join(moved.select(*key), key, "left_anti")
    whole = symbols.filter((F.col("status") != "new") & F.col("name").rlike(r"^\p{Lu}[^.]*$")).join(reached.select(*key, "name"), [*key, "name"], "left_anti")
    gone = base.join(head.select(*by, "endpoint"), [*by, "endpoint"], "left_anti").withColumnRenamed("handler", "node").join(defs.select(*by, "node"), [*by, "node"], "left_semi")
    outside = files.filter("kind = 'outside'").filter(~paths.is_documentation(F.col("path")))
    found = (
        bad.join(code.select(*key), key, "left_semi").withColumn("subject", F.col("path")),
        bad.join(code.select(*key), key, "left_anti").withColumn("subject", F.col("path")),
        failed,
        moved.withColumn("subject", F.col("path")),
        module.withColumn("subject", F.col("path")),
        whole.withColumn("subject", F.concat_ws(":", "path", "name")),
        code.filter("not graphed").withColumn("subject", F.col("path")),
        outside.withColumn("subject", F.col("path")),
        gone.withColumn("subject", F.col("endpoint")),
    )
    return reduce(DataFrame.unionByName, [df.select(*by, F.lit(rule).alias("rule"), "subject").distinct() for rule, df in zip(RULES, found)])
