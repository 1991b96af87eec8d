"""Filters, search, sorting and paging over control tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ferry.functions.text import contains_term

# Schemas that hold no user tables, per engine.
SYSTEM_SCHEMAS = {
    "POSTGRESQL": ("pg_catalog", "information_schema"),
    "MYSQL": ("information_schema", "mysql", "performance_schema", "sys"),
    "SQL_SERVER": ("sys", "INFORMATION_SCHEMA"),
    "ORACLE": (
        "SYS", "SYSTEM", "DBSNMP", "APPQOSSYS", "OUTLN", "XS$NULL",
        "ORACLE_OCM", "FLOWS_FILES", "APEX_PUBLIC_USER", "APEX_040000",
        "APEX_040200", "APEX_030200", "APEX_030100", "APEX_050000",
        "CTXSYS", "MDSYS", "OLAPSYS", "ORDSYS", "ORDPLUGINS",
        "OJVMSYS", "LBACSYS", "WMSYS", "XDB", "ANONYMOUS",
        "SCOTT", "HR", "PM", "SH", "OE", "IX",
    ),
}


def filter_equals(df: DataFrame, **wanted) -> DataFrame:
    """AND of equality filters; an empty value means no filter on that column."""
    for name, value in wanted.items():
        if value:
            df = df.where(F.col(name) == F.lit(value))
    return df


def search_any_column(df: DataFrame, term: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows where any column holds the term, case ignored. A blank term keeps all."""
    if not term.strip():
        return df
    tests = [contains_term(F.col(c), term) for c in (columns or df.columns)]
    return df.where(reduce(lambda a, b: a | b, tests))


def user_tables_only(tables: DataFrame, engine: str) -> DataFrame:
    return tables.where(~F.col("table_schema").isin(*SYSTEM_SCHEMAS[engine]) & (F.col("table_type") == "BASE TABLE"))


def filter_retention(df: DataFrame, column: str, days: int, asof: str) -> DataFrame:
    """Rows no older than ``days`` before ``asof``. The bound is a literal, so it
    reaches the scan."""
    bound = F.lit(asof).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return df.where(F.col(column) >= bound)


def newest_first(df: DataFrame, column: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(column).desc(), F.col(tie).desc())


def page_rows(df: DataFrame, order: Sequence[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, order: str, tie: str, last: tuple, limit: int) -> DataFrame:
    """The next page of a newest-first list by its last key, not by offset: a
    deep page costs what the first one does."""
    when, number = last
    when = F.lit(when).cast(df.schema[order].dataType)
    older = (F.col(order) < when) | ((F.col(order) == when) & (F.col(tie) < F.lit(number)))
    return newest_first(df.where(older), order, tie).limit(limit)


def sort_nulls_last(df: DataFrame, column: str, descending: bool = False, tie: str | None = None) -> DataFrame:
    first = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(first, *([F.col(tie)] if tie else []))
