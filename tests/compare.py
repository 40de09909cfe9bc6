"""Side-by-side check of registered queries against their SQL in DuckDB.

    python tests/compare.py [--sf DIR] [name ...]
"""
import argparse
import datetime
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def oracle_connection(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(body, key=repr)


def spark_table(df):
    return table_of(df.columns, [tuple(r) for r in df.collect()])


def oracle_table(connection, sql):
    cursor = connection.execute(sql)
    return table_of([d[0] for d in cursor.description], cursor.fetchall())


def difference(left, right):
    """None when equal, else a short text."""
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        only = [r for r in left[1] if r not in set(right[1])][:2], [r for r in right[1] if r not in set(left[1])][:2]
        return f"rows {len(left[1])} vs {len(right[1])}: {only}"
    for a, b in zip(left[1], right[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{left[0]}\n   spark  {a}\n   oracle {b}"
    return None


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from __spark_entry__ import oracle_sql, queries

    from colloquy.session import build_session

    spark = build_session(
        "compare", master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered, sqls = queries(), oracle_sql()
    connection = oracle_connection(args.sf)
    failed = 0
    for name in args.names or registered:
        start = time.time()
        try:
            got = spark_table(registered[name](spark, args.sf))
            took, start = time.time() - start, time.time()
            if name not in sqls:
                print(f"rows {name}: {len(got[1])} rows, {took:.1f}s", flush=True)
                continue
            problem = difference(got, oracle_table(connection, sqls[name]))
        except Exception as error:  # noqa: BLE001
            problem, took = f"{type(error).__name__}: {str(error)[:400]}", time.time() - start
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok'} {name}: {took:.1f}s / {time.time() - start:.1f}s {problem or len(got[1])}", flush=True)
    print(f"{failed} failed")
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
