"""Masked tables and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ferry.functions.masking import is_sensitive, is_sensitive_name, mask_value

# Binary and large-object type names, by engine.
BINARY_TYPES = (
    "bytea", "blob", "clob", "binary", "varbinary", "image",
    "longblob", "mediumblob", "tinyblob", "raw", "long raw", "bfile",
    "nclob", "long",
)
ENGINE_BINARY_TYPES = {
    "MYSQL": (
        "blob", "longblob", "mediumblob", "tinyblob", "binary", "varbinary",
        "geometry", "point", "linestring", "polygon", "multipoint",
        "multilinestring", "multipolygon", "geometrycollection",
    ),
    "SQL_SERVER": ("binary", "varbinary", "image", "timestamp", "rowversion"),
    "ORACLE": ("blob", "clob", "nclob", "bfile", "raw", "long raw", "long"),
}


def is_binary_type(name: str, engine: str | None = None) -> bool:
    return name.lower().strip() in ENGINE_BINARY_TYPES.get(engine or "", BINARY_TYPES)


def drop_binary_columns(df: DataFrame, engine: str | None = None) -> DataFrame:
    """Leave out binary columns, by Spark type or by the source type in metadata."""

    def kept(field: T.StructField) -> bool:
        source = field.metadata.get("source_type", "")
        return not isinstance(field.dataType, T.BinaryType) and not is_binary_type(source, engine)

    return df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields if kept(f)])


def masked_names(df: DataFrame, extra: tuple[str, ...] = ()) -> list[str]:
    return sorted({c for c in df.columns if is_sensitive(c, extra)})


def mask_table(df: DataFrame, extra: tuple[str, ...] = (), word_match: bool = False) -> DataFrame:
    """Sensitive columns masked as text, the others as they are; one projection."""
    out = []
    for name in df.columns:
        column = F.col(f"`{name}`")
        out.append((mask_value(name, column) if is_sensitive(name, extra, word_match) else column).alias(name))
    return df.select(*out)


def preview_rows(df: DataFrame, key: str, limit: int = 5, engine: str | None = None) -> DataFrame:
    return mask_table(drop_binary_columns(df, engine).orderBy(key).limit(limit))


def masked_columns(catalog: DataFrame, keys: tuple[str, ...] = ("table_name",)) -> DataFrame:
    """Names of the columns that masking would touch, one row each."""
    return catalog.where(is_sensitive_name(F.col("column_name"))).select(*keys, "column_name").distinct()
