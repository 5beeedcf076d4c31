"""Comparison of a query's rows with its SQL's on DuckDB, in any order."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, folder: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con.sql(sql).df()


def rows(frame) -> list[tuple]:
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    names = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[names].astype(object).values.tolist()), key=str)


def assert_equal(frame, sql: str, folder: str) -> None:
    want = duck(sql, folder)
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows(frame) == rows(want)
