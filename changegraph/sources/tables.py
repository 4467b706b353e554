"""The code-map tables: reads of the fields asked for, repeats counted once, nested passes as flat steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = {"step_no": "bigint", "id": "string", "step_name": "string", "actor": "string", "endpoints": "array<string>", "ui": "array<string>", "code_path": "array<string>", "writes": "array<string>", "confidence": "string", "notes": "string"}
PASS = "pass_no bigint, repo string, area string, run_id string, run_method string, written_at timestamp_ntz, arrived_at timestamp_ntz"


def load(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    """A table; with a schema only the columns and nested fields named there are read."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The named columns of each key once: a row that comes again differs only in when it arrived.

    Only the columns asked for are shuffled. Keys are sorted before and behind the shuffle, which costs less than hashing all columns."""
    return df.select(key, *columns).dropDuplicates([key])


def flatten_steps(runs: DataFrame) -> DataFrame:
    """One row per step of each pass in runs: its columns but flows, flow_pos, flow_id, step_pos and the step's fields."""
    rest = [c for c in runs.columns if c != "flows"]
    flow = runs.select(*rest, F.posexplode("flows").alias("flow_pos", "flow"))
    step = flow.select(*rest, "flow_pos", F.col("flow.id").alias("flow_id"), F.posexplode("flow.steps").alias("step_pos", "step"))
    return step.select(*rest, "flow_pos", "flow_id", "step_pos", "step.*")


def load_steps(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """The steps of map_runs with the step fields asked for, repeats of a pass included; no other field is read."""
    kinds = {"step_no": "bigint"} | {f: STEP[f] for f in fields}
    nested = f"flows array<struct<id: string, steps: array<struct<{', '.join(f'{n}: {t}' for n, t in kinds.items())}>>>>"
    return flatten_steps(load(spark, sf_dir, "map_runs", f"{PASS}, {nested}"))
