"""Session, shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"


def local_session(cpus: int = 8, app: str = "changegraph") -> SparkSession:
    """A session for tests and the bench; on a cluster the session comes from outside."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local master may go without the setting; it gets a folder of its own, removed at exit."""
    named = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {SHARED} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="changegraph-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set(SHARED, f"file://{own}")
    return f"file://{own}"


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """How many tasks a shuffle of so many rows needs: one for `each` rows, and no fewer than the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


STASHES: list["Stash"] = []
PREPARED: dict[tuple[str, str, str], tuple[tuple, object]] = {}


def _as_it_is(spark: SparkSession, folder: str, tables: tuple[str, ...]) -> tuple:
    """Path, length and time of change of every file of the tables."""
    out = []
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{t}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def prepared(spark: SparkSession, folder: str, name: str, tables: tuple[str, ...], make):
    """What make() gives, made once per session for the tables of a folder as they are; made anew when a file of theirs has changed.

    make gives a written table, or an object that holds some: those that several questions start from. `forget` removes them."""
    key, now = (spark.sparkContext.applicationId, folder, name), _as_it_is(spark, folder, tables)
    if PREPARED.get(key, (None,))[0] != now or not _still_there(PREPARED[key][1]):
        PREPARED[key] = (now, make())
    return PREPARED[key][1]


def _still_there(value: object) -> bool:
    """Whether the written tables of a prepared value are still in the shared folder."""
    frames = [value] if isinstance(value, DataFrame) else [x for x in vars(value).values() if isinstance(x, DataFrame)]
    paths = [f._stash_path for f in frames]
    if not paths:
        return False
    spark = frames[0].sparkSession
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return False
    return True


def forget() -> None:
    """Removes all tables that this session wrote to the shared folder; results that still read them can't be read any more."""
    PREPARED.clear()
    _clear_all()
    STASHES.clear()


@atexit.register
def _clear_all() -> None:
    """What is left in the shared folder goes when the driver ends in order."""
    for s in STASHES:
        try:
            s.clear()
        except Exception:  # the session may be gone
            return


class Stash:
    """Tables written to the shared folder to cut lineage; `drop` removes those no longer needed.

    A written table outlives the executors that wrote it. Its rows are counted while it is written (`rows`), so a loop
    needs no job of its own to see whether it is done, and several tables of one schema are read as one (`union`)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        STASHES.append(self)
        self.root = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        return self.put_with(df)[0]

    def put_with(self, df: DataFrame, *measures: Column):
        """The table, and the values of aggregates taken while it was written."""
        self.n += 1
        path, seen = f"{self.root}/{self.n}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("_rows"), *measures).write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        got = seen.get
        back._stash_path, back._stash_rows = path, got.pop("_rows")
        return back, *got.values()

    @staticmethod
    def rows(df: DataFrame) -> int:
        return df._stash_rows

    def union(self, frames: list[DataFrame]) -> DataFrame:
        return self.spark.read.schema(frames[0].schema).parquet(*[f._stash_path for f in frames])

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            if df is not None and getattr(df, "_stash_path", None):
                self._delete(df._stash_path)

    def size(self, df: DataFrame) -> int:
        """Bytes of the table's files."""
        hadoop, fs = self._path(df._stash_path)
        return int(fs.getContentSummary(hadoop).getLength())

    def clear(self) -> None:
        self._delete(self.root)

    def keep(self, *frames: DataFrame) -> None:
        """Removes all tables but these."""
        kept = {f._stash_path for f in frames}
        for n in range(1, self.n + 1):
            if f"{self.root}/{n}" not in kept:
                self._delete(f"{self.root}/{n}")

    def _path(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        hadoop, fs = self._path(path)
        fs.delete(hadoop, True)
