"""A query's rows and its SQL's rows in a form that can be compared."""

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def same(df, con, sql):
    cursor = con.execute(sql)
    wanted = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert found[0] == wanted[0]
    assert found[1] == wanted[1]
