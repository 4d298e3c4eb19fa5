"""A Spark result against DuckDB SQL over the same tables: columns, row count and values without order."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(data_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.5f}"
    if hasattr(v, "__len__") and not isinstance(v, (str, bytes, dict)):
        return str([cell(x) for x in v])
    return str(v)


def rows(d: pd.DataFrame) -> list[tuple]:
    d = d[sorted(d.columns)].astype(object).map(cell)
    return sorted(map(tuple, d.itertuples(index=False)))
