"""Compare a query with its SQL, run by DuckDB over the same files."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    """The rows as sorted text, columns by name."""
    out = []
    for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False):
        out.append(repr(tuple(None if not isinstance(v, (list, str)) and pd.isna(v) else round(v, 9) if isinstance(v, float) else str(v) for v in row)))
    return sorted(out)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    different = sorted(set(a) ^ set(b))
    assert not different, different[:4]
    assert a == b
