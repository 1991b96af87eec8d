"""Reading tables and their catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Spark type → catalog type name.
_CATALOG_NAMES = {
    "int": "integer",
    "bigint": "bigint",
    "string": "varchar",
    "double": "double",
    "float": "float",
    "boolean": "boolean",
    "date": "date",
    "timestamp_ntz": "timestamp",
    "timestamp": "timestamp",
    "binary": "blob",
}


def scan_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def scan_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Named columns in catalog order, however they were asked for."""
    wanted = set(columns)
    missing = wanted - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.select(*[c for c in df.columns if c in wanted])


def scan_chunk(df: DataFrame, key: str, low, high) -> DataFrame:
    """Rows with low <= key < high; the bounds are literals and reach the scan."""
    return df.where((F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high)))


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, quoted_newlines: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rows that do not fit the schema with their raw text.

    All columns are read as text and cast afterwards; whether a row fits looks at
    every column, so the split is the same whichever columns are asked for.
    Texts may hold line breaks; files known to hold none can be cut into many
    tasks with ``quoted_newlines=False``.
    """
    names = [f.name for f in schema.fields]
    texts = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt_record"]])
    rows = (
        spark.read.schema(texts)
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("columnPruning", False)
        .option("escape", '"')
        .option("multiLine", quoted_newlines)
        .csv(path)
    )
    # The length keeps a column beside the raw text in every read, which Spark asks for.
    fits = F.col("_corrupt_record").isNull() & (F.coalesce(F.length(f"`{names[0]}`"), F.lit(0)) >= 0)
    typed = []
    for f in schema.fields:
        text = F.col(f"`{f.name}`")
        value = text if isinstance(f.dataType, T.StringType) else text.try_cast(f.dataType)
        typed.append(value.alias(f.name))
        fits = fits & (text.isNull() | value.isNotNull())
    marked = rows.withColumn("_fits", fits)
    raw = F.coalesce("_corrupt_record", F.to_csv(F.struct(*[F.col(f"`{n}`") for n in names]))).alias("_corrupt_record")
    return marked.where("_fits").select(*typed), marked.where("not _fits").select(*typed, raw)


def catalog_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.DecimalType):
        return "decimal"
    return _CATALOG_NAMES.get(data_type.simpleString(), data_type.simpleString())


def catalog_rows(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column. Only schemas are read, so its size is that of the schemas."""
    rows = []
    for table, df in tables.items():
        for ordinal, f in enumerate(df.schema.fields, 1):
            precision, scale = (
                (f.dataType.precision, f.dataType.scale) if isinstance(f.dataType, T.DecimalType) else (None, None)
            )
            rows.append((table, ordinal, f.name, catalog_type(f.dataType), f.nullable, precision, scale))
    return spark.createDataFrame(
        rows,
        "table_name string, ordinal int, column_name string, column_type string, nullable boolean,"
        " num_precision int, num_scale int",
    )


def scan_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Columns of each table with what its rows say: row count and null count."""
    catalog = catalog_rows(spark, tables)
    stats = None
    for table, df in tables.items():
        measured = df.agg(
            F.count(F.lit(1)).alias("row_count"),
            F.create_map(
                *[x for c in df.columns for x in (F.lit(c), F.count_if(F.col(f"`{c}`").isNull()))]
            ).alias("_nulls"),
        ).select(F.lit(table).alias("table_name"), "row_count", F.explode("_nulls").alias("column_name", "null_count"))
        stats = measured if stats is None else stats.unionByName(measured)
    return catalog.join(stats, ["table_name", "column_name"])
