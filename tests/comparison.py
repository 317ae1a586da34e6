"""Rows of a Spark frame and of a DuckDB query in one comparable form."""

import datetime
import glob
import math
import os

import duckdb


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, datetime.datetime):
        return x.date().isoformat() if x.time() == datetime.time() else x.isoformat()
    if isinstance(x, int | float) or type(x).__name__ == "Decimal":
        return f"{float(x):.6g}" if abs(float(x)) < 1e6 else f"{float(x):.2f}"
    return str(x)


def spark_rows(df):
    names = sorted(df.columns)
    return sorted(tuple(value(r[c]) for c in names) for r in df.collect())


def duck_rows(folder, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got = con.sql(sql)
    names = got.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in got.fetchall())
