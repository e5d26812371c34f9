"""Run queries and their SQL side by side: python -m verification.compare [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession


def local_session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("framewise")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def views(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else repr(v + 0.0))
    return (1, f"{type(v).__name__}:{v}")


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(_cell(r[i]) for i in order) for r in rows])


def compare(spark, con, name: str, query, sql: str | None, sf: str) -> bool:
    start = time.time()
    df = query(spark, sf)
    mine = table_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        print(f"{name:24s} rows {len(mine[1]):7d}  {took:6.1f}s  rows only", flush=True)
        return True
    start = time.time()
    found = con.execute(sql)
    theirs = table_of([c[0] for c in found.description], found.fetchall())
    same = mine == theirs
    print(
        f"{name:24s} rows {len(mine[1]):7d} / {len(theirs[1]):7d}  {took:6.1f}s  "
        f"sql {time.time() - start:5.1f}s  {'ok' if same else 'DIFFERENT'}",
        flush=True,
    )
    if not same:
        print("  columns", mine[0], theirs[0])
        a, b = set(mine[1]), set(theirs[1])
        for row in sorted(a - b)[:3]:
            print("  only spark", str(row)[:600])
        for row in sorted(b - a)[:3]:
            print("  only sql  ", str(row)[:600])
    return same


def main() -> int:
    from .oracle import ORACLE
    from .queries import QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), views(sf)
    bad = []
    for n in names:
        try:
            if not compare(spark, con, n, QUERIES[n], ORACLE.get(n), sf):
                bad.append(n)
        except Exception as e:  # report and go on with the next query
            print(f"{n:24s} FAILED {type(e).__name__}: {str(e)[:1500]}", flush=True)
            bad.append(n)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
