"""Runs a registered query and its SQL twin on the same tables and compares them without order."""

import glob
import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(sf + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.11g}")
    if hasattr(v, "asDict"):
        v = list(v.asDict().values())
    if isinstance(v, dict):
        v = list(v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())


def rows_of_sql(con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    return names, sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
