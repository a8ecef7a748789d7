"""Runs registered queries against their SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


def oracle(sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def same_rows(df, sql, sf=SF):
    names, want = oracle(sql, sf)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    want = [tuple(plain(r[names.index(c)]) for c in order) for r in want]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
