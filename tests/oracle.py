"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def rows_of(table: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "-"
        if isinstance(x, bool):
            return str(x)
        try:
            return f"{float(x):.6f}"
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in table)


def compare(spark, folder: str, query, sql: str) -> str:
    """What differs; empty if nothing does."""
    df = query(spark, folder)
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        path = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from '{path}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    one, other = rows_of([tuple(x) for x in df.collect()], df.columns), rows_of(got.fetchall(), names)
    if one == other:
        return ""
    a, b = sorted(set(one) - set(other)), sorted(set(other) - set(one))
    return f"{len(one)} against {len(other)} rows; {len(a)} and {len(b)} differ, as {a[:2]} against {b[:2]} of {sorted(names)}"
