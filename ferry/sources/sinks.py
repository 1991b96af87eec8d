"""Writing rows: append, lake layout, exports, target creation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, types as T


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def write_lake(df: DataFrame, path: str, partition_by: Sequence[str], mode: str = "overwrite") -> None:
    """Partitioned Parquet. The rebalance in front of the write brings a value's
    rows together, and adaptive execution splits a hot value over several tasks."""
    df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)


def export_csv(df: DataFrame, path: str, visible: Sequence[str], order: Sequence[Column] = ()) -> None:
    """Visible columns in order; null becomes empty text."""
    rows = df.orderBy(*order) if order else df
    rows.select(*visible).write.mode("overwrite").option("header", True).option("nullValue", "").option(
        "emptyValue", ""
    ).option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)


def export_json(df: DataFrame, path: str, order: Sequence[Column], limit: int | None = None) -> None:
    """The rows as JSON in the order given; with a limit, the first of them."""
    rows = df.orderBy(*order)
    (rows if limit is None else rows.limit(limit)).write.mode("overwrite").option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    ).json(path)


def create_target_if_missing(spark: SparkSession, table: str, schema: T.StructType, path: str | None = None) -> bool:
    """Create an empty Parquet table with the source's columns. True when made."""
    if spark.catalog.tableExists(table):
        return False
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{place}")
    return True
