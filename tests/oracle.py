"""Comparing a query with its SQL in DuckDB, rows in any order."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if isinstance(v, float) and v == v:
            return round(v, 9)
        return None if not isinstance(v, (list, tuple)) and pd.isna(v) else v

    columns = sorted(frame.columns)
    return sorted((tuple(map(str, map(plain, r))) for r in frame[columns].astype(object).itertuples(index=False)))


def same(spark, sf_dir, query, sql):
    got, expected = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    for c in got.columns:  # integers with nulls arrive as doubles
        if got[c].dtype == "float64" and str(expected[c].dtype) == "Int64":
            got[c] = got[c].astype("Int64")
    assert rows(got) == rows(expected)
