"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.records import MEM_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, mem: bool = True) -> Callable[[Query], Query]:
    """Registers a query; its SQL may use ``mem`` and must not repeat WITH (``mem`` set: the records come first)."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            text = sql.strip()
            if mem:
                text = f"WITH RECURSIVE {MEM_SQL.strip()}" + (f", {text[5:]}" if text.upper().startswith("WITH ") else f" {text}")
            ORACLES[name] = text
        return f

    return add
