"""Run a query in Spark and its SQL in DuckDB and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import sys

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(normal(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(spark, con, query, sql, sf_dir):
    """None if equal, else a short text."""
    df = query(spark, sf_dir)
    names, got = rows_by_name(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    wanted_names = [c[0] for c in result.description]
    wanted_names, wanted = rows_by_name(wanted_names, result.fetchall())
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if len(got) != len(wanted):
        return f"{len(got)} rows, wanted {len(wanted)}"
    differing = [(a, b) for a, b in zip(got, wanted) if a != b]
    return f"{len(differing)} rows differ, first {differing[0]}" if differing else None


if __name__ == "__main__":
    import time

    from __spark_entry__ import oracle_sql, queries
    from meterloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    settings = {"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"}
    spark = build_session(master="local[8]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name, query in queries().items():
        if (only and name not in only) or name not in oracle_sql():
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, query, oracle_sql()[name], sf_dir) or "ok"
        except Exception as e:  # report and go on with the next query
            verdict = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name:24s} {time.time() - start:6.2f}s {verdict[:900]}", flush=True)
