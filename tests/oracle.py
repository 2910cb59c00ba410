"""Runs a query and its SQL over the same files and compares the rows."""

import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return float(v) if type(v).__name__ == "Decimal" else v


def same_rows(df, sql, sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert have == want
