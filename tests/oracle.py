"""Runs a query and its SQL on the same tables and compares rows as sorted values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:23]
    return int(value) if hasattr(value, "as_tuple") and value == int(value) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def both(spark, con, query, sql, sf_dir):
    got = query(spark, sf_dir)
    found = con.execute(sql)
    return rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of([d[0] for d in found.description], found.fetchall())
