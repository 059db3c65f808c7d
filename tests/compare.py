"""Row-for-row comparison of a Spark query with its SQL twin."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return (1, value.isoformat())
    return (1, str(value))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_cell(row[i]) for i in order) for row in rows])


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def duckdb_connection(sf_dir):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def duckdb_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = [str(d[1]) for d in cursor.description]
    return sorted(names), rows_of(names, cursor.fetchall()), dict(zip(names, types))
