"""Named queries over the given tables, each with its oracle SQL where one is practical."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quercus.sources.tables import VIEW_SQL

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
NEEDS = {"cells": ["numbered_lines"]}


def with_views(body: str, views: list[str]) -> str:
    names = []
    for view in views:
        for name in NEEDS.get(view, []) + [view]:
            if name not in names:
                names.append(name)
    if not names:
        return body
    ctes = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    body = body.strip()
    start = next((s for s in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(s)), None)
    return f"{start}{ctes}, {body[len(start):]}" if start else f"WITH {ctes} {body}"


def query(sql: str | None = None, views: list[str] | None = None, name: str | None = None):
    def register(fn: QueryFn) -> QueryFn:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_views(sql, views or [])
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
