"""Spark rows against DuckDB rows of the same tables."""

import os

import duckdb


def normal(v):
    if v is None:
        return "~null"
    return "%.9g" % v if isinstance(v, float) else str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(normal, r)) for r in df.select(*cols).collect())


def duck(sql, sf_dir):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in os.listdir(sf_dir):
        c.sql(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    r = c.sql(sql)
    at = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
    return [r.columns[i] for i in at], sorted(tuple(normal(x[i]) for i in at) for x in r.fetchall())
