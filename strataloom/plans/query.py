"""Registration of queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataloom.plans.bindings import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def stated(select: str, *tables: str, **ctes: str) -> str:
    """SQL: the named domain tables, further common tables, then the select."""
    parts = [f"{n} AS ({SQL[n]})" for n in tables] + [f"{n} AS ({q})" for n, q in ctes.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {select}"
