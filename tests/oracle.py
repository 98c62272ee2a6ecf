"""Runs a registered query and its oracle on the same tables and compares them."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 8) + 0.0
    return value


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(cells, key=lambda t: tuple((v is None, str(type(v).__name__), str(v)) for v in t))


def compare(df, con, sql) -> str | None:
    """None if equal, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    want = canonical(expected, names)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{sorted(names)}: spark {str(a)[:700]} against oracle {str(b)[:700]}"
    return None


def same_rows(a, b) -> bool:
    """Two DataFrames hold the same rows, whatever their order."""
    assert a.columns == b.columns
    return canonical([tuple(r) for r in a.collect()], a.columns) == canonical([tuple(r) for r in b.collect()], b.columns)
