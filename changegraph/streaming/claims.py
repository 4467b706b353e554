"""The event-driven part: change events come in as JSON files, each (change, head) is claimed once, and one comment per change is kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "change string, head string, command string, body string, at timestamp"
#: A push in command position: environment settings and options of the tool may stand before it.
PUSH = r"(^|[;&|]\s*)(\w+=\S*\s+)*git(\s+-{1,2}[\w-]+([= ]\S+)?)*\s+push\b"


def pushes(command: str):
    """Whether a command line really pushes; what stands in quotes is no command."""
    bare = F.regexp_replace(F.regexp_replace(F.col(command), r"'[^']*'", "''"), r'"[^"]*"', '""')
    return bare.rlike(PUSH)


def claims(events: DataFrame, late: str | None = None) -> DataFrame:
    """The first event of each change and head that pushes.

    Without `late` claims never expire, and the state is one key per head for ever; with it, an interval such as '30 days', an event of a
    head already claimed is taken for new only if it comes later than that, and the state holds the heads of one such interval."""
    pushed = events.filter(pushes("command")).filter("change is not null and head is not null")
    if late is None:
        return pushed.dropDuplicates(["change", "head"])
    return pushed.withWatermark("at", late).dropDuplicatesWithinWatermark(["change", "head"])


#: Rows are kept in so many parts by a hash of the key; a batch rewrites the parts it touches.
BUCKETS = 64


def _parts(spark: SparkSession, path: str, before: int | None = None) -> dict[int, tuple[int, str]]:
    """Bucket -> (version, path) of its latest part, of versions before `before` if given."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, tuple[int, str]] = {}
    for v in fs.listStatus(hadoop) if fs.exists(hadoop) else []:
        number = int(v.getPath().getName().split("=")[1])
        if before is not None and number >= before:
            continue
        for b in fs.listStatus(v.getPath()):
            name = b.getPath().getName()
            if name.startswith("bucket="):
                bucket = int(name.split("=")[1])
                out[bucket] = max(out.get(bucket, (-1, "")), (number, b.getPath().toString()))
    return out


def upsert(path: str, marker: str = "change") -> Callable[[DataFrame, int], None]:
    """Keeps one row per change at path, the one of the latest event: a batch is merged with the buckets it touches, which are written as a
    new version of their own; other buckets stay as they are.

    Each version has its batch's number, so a batch that comes again writes the same version again. A bucket's version before the
    last is kept for readers that have begun with it."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucketed = batch.withColumn("bucket", F.pmod(F.xxhash64(marker), F.lit(BUCKETS)).cast("int")).persist()
        touched = [r[0] for r in bucketed.select("bucket").distinct().collect()]  # at most BUCKETS
        earlier = _parts(spark, path, number)
        old = [earlier[b][1] for b in touched if b in earlier]
        every = bucketed
        if old:
            every = every.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("bucket", F.pmod(F.xxhash64(marker), F.lit(BUCKETS)).cast("int")))
        latest = every.groupBy(marker).agg(F.max_by(F.struct(*every.columns), F.struct("at", "head")).alias("r")).select("r.*")
        latest.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")
        bucketed.unpersist()
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for b in touched:
            if b in earlier:
                before = _parts(spark, path, earlier[b][0]).get(b)
                if before:
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(before[1]), True)

    return merge


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of every bucket that upsert wrote."""
    return spark.read.parquet(*[p for _, p in _parts(spark, path).values()])


def run(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = True, late: str | None = None) -> StreamingQuery:
    """Event files in source to the table of comments in target."""
    events = spark.readStream.schema(EVENT).json(source)
    writer = claims(events, late).writeStream.foreachBatch(upsert(target)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
