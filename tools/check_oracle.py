"""Run registered queries against their SQL on the same files: check_oracle.py [sf] [name substring …]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
         "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "∅"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, text, sf_dir):
    """(problem or None, row count, seconds)"""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if text is None:
        return None, len(got), took
    rel = con.sql(text)
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    if sorted(df.columns) != sorted(types):
        return f"columns {sorted(df.columns)} != {sorted(types)}", len(got), took
    bad = [(c, t, types[c]) for c, t in df.dtypes if KINDS.get(t, t) != types[c]]
    a, b = rows_of(df.columns, got), rows_of(rel.columns, rel.fetchall())
    if a != b:
        extra = [x for x in a if x not in set(b)][:2]
        missing = [x for x in b if x not in set(a)][:2]
        return f"rows {len(a)} != {len(b)}" if len(a) != len(b) and False else f"rows {len(a)}/{len(b)} spark-only {extra} sql-only {missing}", len(got), took
    return (f"types {bad}" if bad else None), len(got), took


if __name__ == "__main__":
    from tidemark.plans import ORACLES, QUERIES

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0][0].isdigit() else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, failed = session(), database(sf_dir), 0
    for name, fn in QUERIES.items():
        if args and not any(a in name for a in args):
            continue
        try:
            problem, n, took = compare(spark, con, fn, ORACLES.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            problem, n, took = f"{type(e).__name__}: {str(e)[:700]}", -1, 0
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:42s} {n:7d} rows {took:6.2f}s {'' if name in ORACLES else '(no sql)'} {problem or ''}", flush=True)
    print("failed", failed)
