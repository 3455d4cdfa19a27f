"""Compare registered queries with their SQL in DuckDB: names, rows and values."""

from __future__ import annotations

import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    try:
        return norm(float(v)) if not isinstance(v, int) else v
    except (TypeError, ValueError):
        return str(v)


def difference(con, sql: str, df) -> str | None:
    got = df.toPandas()
    want = con.sql(sql)
    if sorted(want.columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)}, SQL has {sorted(want.columns)}"
    cols = sorted(want.columns)
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    a = sorted((tuple(norm(x) for x in r) for r in got[cols].astype(object).where(got[cols].notna(), None).itertuples(index=False)), key=key)
    b = sorted((tuple(norm(x) for x in r) for r in want.select(", ".join(f'"{c}"' for c in cols)).fetchall()), key=key)
    if len(a) != len(b):
        return f"{len(a)} rows, SQL has {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-5 * max(1, abs(q)) for p, q in zip(x, y, strict=True))]
    return f"{len(bad)} of {len(a)} rows differ: {bad[:2]}" if bad else None
