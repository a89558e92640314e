"""Compare a registered query with its SQL in DuckDB, order-insensitively."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(_cell(v) for v in r) for r in pdf.itertuples(index=False, name=None)), key=repr)


def check(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.toPandas()
    took = time.time() - t0
    if sql is None:
        assert len(got.columns) > 0
        return f"{name}: rows-only {len(got)} ({took:.1f}s)"
    t0 = time.time()
    want = con.execute(sql).df()
    sql_took = time.time() - t0
    assert sorted(got.columns) == sorted(want.columns), (sorted(got.columns), sorted(want.columns))
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if str(got[c].dtype) != str(want[c].dtype)}
    a, b = _rows(got), _rows(want)
    assert len(a) == len(b), f"{name}: {len(a)} rows, expected {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, f"{name}: {len(bad)} rows differ, e.g. {bad[:2]}"
    return f"{name}: ok {len(a)} rows ({took:.1f}s, sql {sql_took:.1f}s)" + (f" dtypes {kinds}" if kinds else "")
