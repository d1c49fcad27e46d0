"""Compare registered queries with their SQL twins on DuckDB.

Run by hand:  python -m tests.oracle [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


def make_spark():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("paperfold-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder):
    from paperfold.sources.tables import NAMES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return f"{type(v).__name__}:{v!r}"


def table(cols, rows):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(tuple(plain(r[i]) for i in idx) for r in rows)


def compare(spark, con, name, folder):
    from paperfold.catalog import REGISTRY, runner

    t0 = time.time()
    df = runner(name)(spark, str(folder))
    left = table(df.columns, [tuple(r) for r in df.collect()])
    secs = time.time() - t0
    sql = REGISTRY[name].sql
    if not sql:
        return len(left[1]), secs, None
    cur = con.execute(sql)
    right = table([d[0] for d in cur.description], cur.fetchall())
    if left == right:
        return len(left[1]), secs, None
    if left[0] != right[0]:
        return len(left[1]), secs, f"columns {left[0]} != {right[0]}"
    a, b = set(left[1]), set(right[1])
    return len(left[1]), secs, (
        f"{len(left[1])} vs {len(right[1])} rows {left[0]}; only spark {sorted(a - b)[:3]}; "
        f"only sql {sorted(b - a)[:3]}"
    )


def main(argv):
    sf = "0.001"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i:i + 2]
    from paperfold.catalog import REGISTRY

    names = [n for n in REGISTRY if not argv or any(n.startswith(p) for p in argv)]
    spark, folder = make_spark(), DATA / f"sf{sf}"
    con = duck(folder)
    bad = 0
    for n in names:
        try:
            rows, secs, err = compare(spark, con, n, folder)
            zero = "  ZERO-ROWS" if rows == 0 else ""
            print(f"{'ok  ' if err is None else 'FAIL'} {n:38s} {rows:8d} {secs:6.2f}s{zero} {'' if REGISTRY[n].sql else '(rows only)'} {err or ''}", flush=True)
            bad += err is not None
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {n} {type(e).__name__}: {str(e)[:700]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
