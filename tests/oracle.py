"""Runs a registered query in Spark and its SQL twin in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

TABLE_DIR = "/root/testdata"


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def cell(x):
    if x is None:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        if math.isnan(x) or math.isinf(x):
            return str(x)
        return int(x) if x == int(x) and abs(x) < 1e15 else round(x, 5)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(cell(v) for v in x)
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_table(con, sql):
    cur = con.execute(sql)
    return table([d[0] for d in cur.description], cur.fetchall())


def compare(spark, con, name, fn, sql, folder):
    left = spark_table(fn(spark, folder))
    if sql is None:
        return f"rows only: {len(left[1])}" if left[1] else "EMPTY"
    right = duck_table(con, sql)
    if left[0] != right[0]:
        return f"COLUMNS {left[0]} vs {right[0]}"
    if left[1] != right[1]:
        a, b = set(left[1]), set(right[1])
        return (f"ROWS {len(left[1])} vs {len(right[1])}\n   spark only {sorted(a - b, key=repr)[:3]}"
                f"\n   sql only   {sorted(b - a, key=repr)[:3]}")
    return "ok" if left[1] else "EMPTY"


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = os.environ.get("SF", "0.01")
    folder = f"{TABLE_DIR}/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(a in n for a in argv)]
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            verdict = compare(spark, con, name, queries[name], sqls.get(name), folder)
        except Exception as e:  # report and go on
            verdict = "ERROR " + str(e)[:700]
        good = verdict == "ok" or verdict.startswith("rows only")
        bad += not good
        print(f"{time.time() - t0:6.1f}s {name}: {verdict}", flush=True)
    print(f"{len(names)} queries, {bad} bad", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
