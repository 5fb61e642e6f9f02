"""Runs a query and its SQL twin over the same tables and compares values."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat(" ")
    return "~" if v is None else str(v)


def same(df, con, sql):
    r = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    at = [r.columns.index(c) for c in cols]
    a = sorted(tuple(norm(x[c]) for c in cols) for x in df.collect())
    b = sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())
    assert a == b
    return len(a)
