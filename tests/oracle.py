"""Compare a query's rows with its SQL's, run by DuckDB on the same tables."""

import datetime
import os

import duckdb


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def same(con, df, sql):
    cols = sorted(df.columns)
    got = sorted(repr(tuple(normal(r[c]) for c in cols)) for r in df.select(cols).collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(normal(r[names.index(c)]) for c in cols)) for r in res.fetchall())
    assert got == want
