"""Comparison of a query with its SQL in DuckDB, by values, whatever their order."""

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return str(v)


def connect():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def same(df, connection, sql):
    got = df.collect()
    result = connection.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(_plain(r[names.index(n)]) for n in order) for r in result.fetchall())
    assert sorted(tuple(_plain(r[n]) for n in order) for r in got) == want
