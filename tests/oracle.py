"""Runs a query beside its DuckDB SQL and compares the rows."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set threads to 4")
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"create view {t} as select * from read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, dict):
        return str(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def compare(spark, sf_dir, f, sql):
    df = f(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rows(names, rel.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(mine) == len(theirs)
    assert mine == theirs, next((a, b) for a, b in zip(mine, theirs) if a != b)
    return mine
