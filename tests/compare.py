"""Query and SQL side by side, as multisets of rows."""

import glob
import math
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


def both(spark, sf, query, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    r = con.sql(sql)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    return got, sorted(tuple(_plain(x[i]) for i in at) for x in r.fetchall())
