"""Runs a registered query and its SQL and compares columns and rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def compare(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    ours = sorted((tuple(map(_plain, r)) for r in df.select(*columns).collect()), key=repr)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert ours == theirs
