"""Runs a query and its DuckDB SQL over the same tables and compares the rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = SF):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    """Rows in any order as text, floats to nine digits."""
    def text(v):
        if v is None or (not isinstance(v, (list, dict)) and not hasattr(v, "__len__") and pd.isna(v)):
            return "NULL"
        v = v.item() if hasattr(v, "item") and getattr(v, "ndim", 0) == 0 else v
        return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def check(spark, query, sql: str, sf_dir: str = SF) -> None:
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b
