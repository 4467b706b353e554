"""Runs a query in Spark and its SQL in DuckDB and compares the rows, in any order. python tests/oracle.py SF [NAME...]"""

from __future__ import annotations

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def compare(spark, name, query, sql, sf_dir: str) -> str:
    """'' if equal, else what differs."""
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = Counter(plain(tuple(r)) for r in df.select(*columns).collect())
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != columns:
        return f"{name}: columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = Counter(plain(tuple(r[i] for i in order)) for r in rel.fetchall())
    if ours == theirs:
        return ""
    return f"{name}: {sum(ours.values())} rows against {sum(theirs.values())}; only ours {list((ours - theirs).items())[:3]}; only SQL's {list((theirs - ours).items())[:3]}"


if __name__ == "__main__":
    import time

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from changegraph.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, sql in entry.oracle_sql().items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        t = time.time()
        try:
            why = compare(spark, name, entry.queries()[name], sql, str(TESTDATA / sys.argv[1]))
        except Exception as e:
            why = f"{name}: {type(e).__name__} {str(e)[:700]}"
        bad += bool(why)
        print("ok  " if not why else "BAD ", name, f"{time.time() - t:.1f}s", why[:1500], flush=True)
    sys.exit(bad)
