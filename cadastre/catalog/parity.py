"""Order-free comparison of a query with its SQL twin."""

from __future__ import annotations

import math
import os


def canonical(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(f"{value:.6g}") if abs(value) > 1e6 else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, bool):
        return value
    if hasattr(value, "tolist"):
        return canonical(value.tolist())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v).__name__ in ("str",)), str(v)) for v in r))


def duckdb_views(folder: str):
    """DuckDB connection with every parquet file of the folder as a view."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con
