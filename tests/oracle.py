"""Spark results against DuckDB on the same files."""

from __future__ import annotations

import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def key(row):
    return tuple((x is None, str(x)) for x in row)


def same(df, sql: str, sf: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    want = r.fetchall()
    cols = sorted(df.columns)
    assert cols == sorted(names)
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(x[i]) for i in at) for x in want), key=key)
    got = sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=key)
    assert len(got) == len(want)
    assert got == want
