"""Compares queries with their SQL over one folder of tables."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        col = frame[c]
        if pd.api.types.is_float_dtype(col):
            whole = col.dropna()
            if len(whole) and (whole == whole.round()).all():
                frame[c] = col.astype("Int64")
            else:
                frame[c] = col.round(6)
    text = frame.map(lambda v: "NULL" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else str(v))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def differences(spark, queries, sqls, name: str, sf_dir: str) -> str:
    got = canonical(queries[name](spark, sf_dir).toPandas())
    want = canonical(connect(sf_dir).execute(sqls[name]).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} but SQL has {list(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows but SQL has {len(want)}"
    bad = (got != want).any(axis=1)
    return "" if not bad.any() else f"{bad.sum()} rows differ:\n{got[bad].head(5)}\n{want[bad].head(5)}"
