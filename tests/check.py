"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "<null>"
        return f"f{v:.10g}"
    if isinstance(v, bool):
        return f"b{v}"
    return f"{type(v).__name__}:{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    """(status, message, seconds)."""
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return ("rows" if got else "EMPTY"), f"{len(got)} rows", took
    res = con.execute(sql)
    want_names = [d[0] for d in res.description]
    want = res.fetchall()
    a_names, a = rows_of(df.columns, got)
    b_names, b = rows_of(want_names, want)
    if a_names != b_names:
        return "FAIL", f"columns {a_names} / {b_names}", took
    if len(a) != len(b):
        return "FAIL", f"rows {len(a)} / {len(b)}: {a[:2]} / {b[:2]}", took
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return "FAIL", f"{len(diff)} of {len(a)} rows differ: {diff[:2]}", took
    return ("ok" if a else "EMPTY"), f"{len(a)} rows", took


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = "/root/testdata/sf0.01"
    only = []
    for a in argv:
        if a.startswith("/"):
            sf = a
        else:
            only.append(a)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    checks = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if only and not any(name == o or name.startswith(o + "*") or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        try:
            status, message, took = compare(spark, con, sf, name, fn, checks.get(name))
        except Exception as error:
            status, message, took = "ERROR", str(error)[:700], 0.0
            if only:
                traceback.print_exc(limit=6)
        if status in ("FAIL", "ERROR", "EMPTY"):
            bad += 1
        if status != "ok" or only:
            print(f"{status:6} {name} {took:.1f}s {message}", flush=True)
    print("bad:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
