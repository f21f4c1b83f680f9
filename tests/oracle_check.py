"""Rows of a Spark query against rows of a DuckDB statement, in any order."""

import os

import duckdb


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 5) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def connect(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{folder}/{f}')")
    return c


def same_rows(df, con, sql):
    got = con.sql(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    theirs = sorted(tuple(str(plain(r[i])) for i in order) for r in got.fetchall())
    ours = sorted(tuple(str(plain(r[c])) for c in sorted(names)) for r in df.collect())
    assert len(ours) == len(theirs)
    assert ours == theirs
