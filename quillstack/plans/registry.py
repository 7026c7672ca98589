"""Registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.library import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None, *views: str):
    """Register a function under its name; views are CTEs of the library that the SQL uses."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = "WITH RECURSIVE " + ",\n".join(SQL[v] for v in views) if views else ""
            body = sql.strip()
            if views and body.upper().startswith("WITH "):
                head, body = head + ",\n", body[5:]
            ORACLE[f.__name__] = f"{head}\n{body}"
        return f

    return add
