"""Compares a query's rows with its SQL in DuckDB, in any order; doubles to nine digits."""

import math
from pathlib import Path

import duckdb


def views(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


def compare(df, sql: str, sf_dir: str) -> None:
    got = df.toArrow().to_pylist()
    want = views(sf_dir).execute(sql).to_arrow_table().to_pylist()
    assert sorted(df.columns) == sorted(want[0] if want else df.columns)
    key = lambda r: [(v is None, str(_norm(v))) for _, v in sorted(r.items())]
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert {k: _norm(v) for k, v in a.items()} == {k: _norm(v) for k, v in b.items()}
