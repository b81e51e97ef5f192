"""Compare queries with their SQL: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import load_all

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cpus: str = "8"):
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("faultline")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate())


def canonical(rows):
    def cell(v):
        if isinstance(v, float):
            return "NaN" if math.isnan(v) else f"{v:.9g}"
        if isinstance(v, bool) or v is None:
            return str(v)
        return f"{float(v):.9g}" if isinstance(v, int) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = canonical(tuple(r) for r in df.select(*cols).collect())
    took = time.time() - t
    if sql is None:
        return f"rows={len(got)}", took
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"FAIL columns spark={cols} sql={sorted(rel.columns)}", took
    want = canonical(con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
    if got == want:
        return f"ok {len(got)}", took
    g, w = set(got), set(want)
    return (f"FAIL rows spark={len(got)} sql={len(want)}\n  only spark: {list(g - w)[:2]}\n"
            f"  only sql:   {list(w - g)[:2]}"), took


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    reg = load_all()
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name, fn in reg.QUERIES.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            res, took = compare(spark, con, name, fn, reg.ORACLES.get(name), sf)
        except Exception as e:  # report and go on
            res, took = f"FAIL {type(e).__name__}: {str(e)[:400]}", 0
        bad += res.startswith("FAIL")
        print(f"{name:34s} {took:6.1f}s {res}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
