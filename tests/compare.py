"""Rows of a query against rows of its SQL."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def rows(found: list, columns: list[str]) -> list[tuple]:
    at = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: round(v, 9) if isinstance(v, float) else repr(v) if isinstance(v, list | dict) else v
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=lambda r: tuple(map(str, r)))


def same(frame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows([tuple(r) for r in frame.collect()], frame.columns) == rows(cursor.fetchall(), columns)
