"""Value conversion between engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Engine type names → Spark type. Sizes are handled by the caller.
SPARK_TYPES = {
    "integer": "int",
    "int": "int",
    "smallint": "smallint",
    "bigint": "bigint",
    "varchar": "string",
    "char": "string",
    "text": "string",
    "decimal": "decimal",
    "numeric": "decimal",
    "date": "date",
    "datetime": "timestamp_ntz",
    "timestamp": "timestamp_ntz",
    "boolean": "boolean",
    "float": "double",
    "double": "double",
    "json": "string",
    "blob": "binary",
    "bytea": "binary",
}


def json_text(text: Column) -> Column:
    """Valid JSON in a canonical spelling; invalid text is kept as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def datetime_text(value: Column, data_type: T.DataType) -> Column:
    """Dates and times as text: six digits of fraction, or none when it is zero."""
    if isinstance(data_type, T.StringType):
        return value
    if isinstance(data_type, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    fine = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.when(fine.endswith(".000000"), whole).otherwise(fine)


def boolean_value(value: Column, data_type: T.DataType) -> Column:
    return value.cast("boolean") if isinstance(data_type, T.IntegralType) else value


def convert_columns(df: DataFrame, kinds: dict[str, str], source_engine: str, target_engine: str) -> DataFrame:
    """Apply the rule each column's source type asks for. Same engine: unchanged."""
    if source_engine.lower() == target_engine.lower():
        return df
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name in df.columns:
        kind, column = kinds.get(name, "").lower(), F.col(f"`{name}`")
        if kind == "json":
            column = json_text(column)
        elif kind in ("datetime", "timestamp", "date"):
            column = datetime_text(column, types[name])
        elif kind == "boolean":
            column = boolean_value(column, types[name])
        out.append(column.alias(name))
    return df.select(*out)


def map_types(columns: DataFrame, mapping: DataFrame) -> DataFrame:
    """Join catalog rows to a (engine, source_type, target_type) mapping.

    Unmapped types fall back to the upper-cased source name. The mapping has one
    row per engine type name, so its size does not follow the data.
    """
    known = F.broadcast(mapping.select("engine", "source_type", "target_type"))
    return columns.join(known, ["engine", "source_type"], "left").withColumn(
        "target_type", F.coalesce("target_type", F.upper("source_type"))
    )


def type_mapping(spark, engines: tuple[str, ...] = ("MYSQL", "POSTGRESQL")) -> DataFrame:
    rows = [(e, s, t) for e in engines for s, t in SPARK_TYPES.items()]
    return spark.createDataFrame(rows, "engine string, source_type string, target_type string")
