"""Compare a Spark result with DuckDB's: columns by name, rows in any order, values as text."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c.execute(sql).df()


def assert_same(got, want) -> None:
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda x: x[cols].astype(str).sort_values(cols).reset_index(drop=True)
    got, want = norm(got), norm(want)
    assert len(got) == len(want)
    bad = (got != want).any(axis=1)
    assert not bad.any(), (got[bad].head(3).to_dict("records"), want[bad].head(3).to_dict("records"))
