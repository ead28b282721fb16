"""Compare a query with its SQL on the same tables, regardless of row order."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def value(x: object) -> str:
    if x is None or not hasattr(x, "__len__") and pd.isna(x):
        return "<null>"
    return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
