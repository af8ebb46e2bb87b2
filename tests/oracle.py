"""Holds a registered query against its SQL on DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return tuple(map(_plain, value)) if isinstance(value, list | tuple) else value


def assert_same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(_plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want
