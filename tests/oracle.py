"""Compare registered queries with DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql) -> str | None:
    """A short description of the first difference, or None."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    want = _rows(names, found.fetchall())
    have = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(have):
        return f"rows {len(have)} != {len(want)}; first {have[:1]} / {want[:1]}"
    for h, w in zip(have, want):
        if h != w or [type(v) for v in h] != [type(v) for v in w]:
            return f"{sorted(names)}: {h} != {w}"
    return None
