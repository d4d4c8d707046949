"""Run a query and its SQL on the same tables and compare names and values."""

import math
import os

import duckdb


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([value(r[i]) for i in order] for r in rows), key=repr)


def same(spark, directory, f, sql):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(directory):
        con.execute(f"create view {name[:-8]} as from '{directory}/{name}'")
    df = f(spark, directory)
    got = [tuple(r) for r in df.collect()]
    r = con.execute(sql)
    want_cols, want = [c[0] for c in r.description], r.fetchall()
    assert sorted(df.columns) == sorted(want_cols)
    assert table(df.columns, got) == table(want_cols, want)
