"""Comparison of a query with its SQL oracle in DuckDB, whatever the order of rows and columns."""

import glob
import math
import os

import duckdb


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    if hasattr(v, "is_finite"):
        return float(v)
    return v if isinstance(v, int) else str(v)


def rows(cols, records):
    return sorted((tuple(norm(r[c]) for c in cols) for r in records), key=repr)


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, sf, con, query, sql):
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = rows(cols, df.collect())
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    want = rows(cols, [dict(zip(names, r)) for r in res.fetchall()])
    assert got == want
    return len(got)
