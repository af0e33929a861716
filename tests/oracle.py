"""Rows of a query and of its SQL, in one form."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa


def connection(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, np.integer)):
        return str(int(x))
    if isinstance(x, (float, np.floating)):
        return "null" if math.isnan(x) else repr(round(float(x), 6) + 0.0)
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(_plain, x)) + "]"
    return str(x)


def rows(frame: pd.DataFrame | pa.Table) -> list[tuple]:
    """Of an Arrow table each value keeps its type, null or not."""
    if isinstance(frame, pa.Table):
        names = sorted(frame.column_names)
        return sorted(tuple(map(_plain, r)) for r in zip(*(frame[c].to_pylist() for c in names), strict=True))
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_plain, r)) for r in frame.itertuples(index=False))
