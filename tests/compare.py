"""Runs a registered query and its SQL twin and compares whole results."""

from __future__ import annotations

import argparse
import importlib
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def norm(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value + 0.0, 6) + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(norm(v) for v in value) + "]"
    try:
        return repr(round(float(value), 6)) if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, name, fn, sql, folder):
    """None if equal, else a text; also the number of rows and seconds."""
    start = time.time()
    df = fn(spark, folder)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return None, len(got), took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got), took
    left, right = rows_of(df.columns, got), rows_of(names, want)
    if left == right:
        return None, len(got), took
    bad = [(a, b) for a, b in zip(left, right) if a != b][:3]
    only_l = sorted(set(left) - set(right))[:3]
    only_r = sorted(set(right) - set(left))[:3]
    return f"{len(left)} vs {len(right)} rows; first {bad[:1]}; spark only {only_l}; sql only {only_r}", len(got), took


def main():
    from panelytics.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("pattern", nargs="*", default=[""])
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    args = ap.parse_args()
    entry = importlib.import_module("__spark_entry__")
    spark = local_session(8, spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if not any(name.startswith(p) for p in args.pattern):
            continue
        try:
            err, n, took = compare(spark, con, name, fn, sql.get(name), args.sf)
        except Exception as e:  # noqa: BLE001
            err, n, took = f"{type(e).__name__}: {str(e)[:1200]}", -1, 0
        bad += err is not None
        state = "ok" if err is None else "FAIL"
        print(f"{state:4} {name:34} rows={n:<8} {took:6.2f}s {'' if name in sql else '(no sql)'} {err or ''}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
