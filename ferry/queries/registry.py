"""Collects the queries of this package with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ferry.inputs import Inputs, with_tables

RUNS: dict[str, Callable[[Inputs], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Register a query; ``tables`` are the derived tables its SQL names."""

    def add(run: Callable[[Inputs], DataFrame]):
        if name in RUNS:
            raise ValueError(f"{name} is registered twice")
        RUNS[name] = run
        if sql is not None:
            SQL[name] = with_tables(sql, *tables) if tables else sql
        return run

    return add
