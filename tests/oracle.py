"""Runs a query and its SQL and compares them, rows in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def ordered(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None else str(x))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def same(got, expected):
    assert sorted(got.columns) == sorted(expected.columns)
    a, b = ordered(got), ordered(expected)
    assert len(a) == len(b)
    for c in a.columns:
        equal = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert equal.all(), (c, a[~equal].head(3), b[~equal].head(3))
