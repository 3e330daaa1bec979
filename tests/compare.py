"""Holds registered queries against their SQL in DuckDB, as sorted rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def held(spark, sf_dir, query, sql):
    """Number of rows if both sides agree; raises otherwise."""
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    want = con.sql(sql)
    names, data = want.columns, want.fetchall()
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    got, expected = rows(df.columns, df.collect()), rows(names, data)
    assert len(got) == len(expected), (len(got), len(expected))
    for a, b in zip(got, expected, strict=True):
        assert a == b, (a, b)
    return len(got)
