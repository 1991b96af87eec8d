"""Database endpoints through Spark's own JDBC source and sink."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, types as T

_URLS = {
    "MYSQL": "jdbc:mysql://{host}:{port}/{database}",
    "POSTGRESQL": "jdbc:postgresql://{host}:{port}/{database}",
    "SQL_SERVER": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "ORACLE": "jdbc:oracle:thin:@//{host}:{port}/{database}",
}
_QUOTES = {"MYSQL": ("`", "`"), "SQL_SERVER": ("[", "]")}

_COLUMNS = (
    "select table_name, ordinal_position, column_name, data_type, is_nullable, column_default,"
    " character_maximum_length, numeric_precision, numeric_scale from information_schema.columns where table_schema = {schema}"
)
_KEYS = (
    "select c.table_name, c.constraint_name, k.column_name, k.ordinal_position from information_schema.table_constraints c"
    " join information_schema.key_column_usage k on k.constraint_schema = c.constraint_schema"
    " and k.constraint_name = c.constraint_name and k.table_name = c.table_name"
    " where c.constraint_type = 'PRIMARY KEY' and c.table_schema = {schema}"
)
# The n-th column of a key refers to the n-th referenced one.
_REFERENCES = (
    "select k.table_name, k.constraint_name, k.column_name, k.ordinal_position, u.table_name as referenced_table_name,"
    " u.column_name as referenced_column_name from information_schema.referential_constraints r"
    " join information_schema.key_column_usage k on k.constraint_schema = r.constraint_schema and k.constraint_name = r.constraint_name"
    " join information_schema.key_column_usage u on u.constraint_schema = r.unique_constraint_schema"
    " and u.constraint_name = r.unique_constraint_name and u.ordinal_position = k.position_in_unique_constraint"
    " where r.constraint_schema = {schema}"
)
_TABLES = "select table_schema, table_name, table_type from information_schema.tables"

# What each engine's catalog is asked. `row_estimates` reads statistics only and
# gives null where the engine has none.
CATALOG_QUERIES = {
    "MYSQL": {
        "tables": _TABLES,
        "columns": _COLUMNS.format(schema="database()"),
        "primary_keys": _KEYS.format(schema="database()"),
        "foreign_keys": (
            "select table_name, constraint_name, column_name, ordinal_position, referenced_table_name, referenced_column_name"
            " from information_schema.key_column_usage"
            " where table_schema = database() and referenced_table_name is not null"
        ),
        "indexes": (
            "select table_name, index_name, column_name, seq_in_index, non_unique from information_schema.statistics"
            " where table_schema = database()"
        ),
        "row_estimates": "select table_name, table_rows as estimated_rows from information_schema.tables where table_schema = database()",
    },
    "POSTGRESQL": {
        "tables": _TABLES,
        "columns": _COLUMNS.format(schema="'public'"),
        "primary_keys": _KEYS.format(schema="'public'"),
        "foreign_keys": _REFERENCES.format(schema="'public'"),
        "indexes": "select tablename as table_name, indexname as index_name, indexdef from pg_indexes where schemaname = 'public'",
        "row_estimates": (
            "select relname as table_name, nullif(greatest(reltuples, 0), 0)::bigint as estimated_rows from pg_class"
            " where relkind = 'r' and relnamespace = 'public'::regnamespace"
        ),
    },
    "SQL_SERVER": {
        "tables": _TABLES,
        "columns": _COLUMNS.format(schema="schema_name()"),
        "primary_keys": _KEYS.format(schema="schema_name()"),
        "foreign_keys": (
            "select object_name(parent_object_id) as table_name, object_name(constraint_object_id) as constraint_name,"
            " col_name(parent_object_id, parent_column_id) as column_name, constraint_column_id as ordinal_position,"
            " object_name(referenced_object_id) as referenced_table_name,"
            " col_name(referenced_object_id, referenced_column_id) as referenced_column_name from sys.foreign_key_columns"
        ),
        "indexes": "select object_name(object_id) as table_name, name as index_name, is_unique from sys.indexes where name is not null",
        "row_estimates": (
            "select object_name(object_id) as table_name, sum(rows) as estimated_rows from sys.partitions"
            " where index_id in (0, 1) group by object_id"
        ),
    },
    "ORACLE": {
        "tables": "select owner as table_schema, table_name, 'BASE TABLE' as table_type from all_tables",
        "columns": (
            "select table_name, column_id as ordinal_position, column_name, data_type, nullable as is_nullable,"
            " char_length as character_maximum_length, data_precision as numeric_precision, data_scale as numeric_scale"
            " from user_tab_columns"
        ),
        "primary_keys": (
            "select c.table_name, c.constraint_name, k.column_name, k.position as ordinal_position from user_constraints c"
            " join user_cons_columns k on k.constraint_name = c.constraint_name where c.constraint_type = 'P'"
        ),
        "foreign_keys": (
            "select c.table_name, c.constraint_name, k.column_name, k.position as ordinal_position,"
            " r.table_name as referenced_table_name, r.column_name as referenced_column_name from user_constraints c"
            " join user_cons_columns k on k.constraint_name = c.constraint_name"
            " join user_cons_columns r on r.constraint_name = c.r_constraint_name and r.position = k.position"
            " where c.constraint_type = 'R'"
        ),
        "indexes": "select table_name, index_name, uniqueness from user_indexes",
        "row_estimates": "select table_name, num_rows as estimated_rows from user_tables",
    },
}


def quote(name: str, engine: str) -> str:
    left, right = _QUOTES.get(engine.upper(), ('"', '"'))
    return f"{left}{name.replace(right, right * 2)}{right}"


def quote_table(table: str | Sequence[str], engine: str) -> str:
    """``schema.table`` quoted part by part; a name that holds a dot is given in parts."""
    return ".".join(quote(part, engine) for part in (table.split(".") if isinstance(table, str) else table))


def literal(value: object, engine: str) -> str:
    """A value as the engine's SQL spells it."""
    if isinstance(value, bool):
        return str(int(value)) if engine.upper() in ("SQL_SERVER", "ORACLE") else str(value).upper()
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    if isinstance(value, bytes):
        return {"POSTGRESQL": f"'\\x{value.hex()}'", "SQL_SERVER": f"0x{value.hex()}", "ORACLE": f"hextoraw('{value.hex()}')"}.get(engine.upper(), f"x'{value.hex()}'")
    text = "'" + str(value).replace("'", "''") + "'"
    if engine.upper() == "MYSQL":
        text = text.replace("\\", "\\\\")
    kind = "TIMESTAMP " if isinstance(value, datetime) else "DATE " if isinstance(value, date) else ""
    return text if engine.upper() == "SQL_SERVER" else kind + text


def options(engine: str, host: str, port: int, database: str, user: str, password: str, **extra: str) -> dict[str, str]:
    return {
        "url": _URLS[engine.upper()].format(host=host, port=port, database=database),
        "user": user,
        "password": password,
        **extra,
    }


def _from(names: Sequence[str], bound: Sequence, engine: str) -> str:
    """The rows at or after a bound, columns compared one after the other. Spelled out:
    not every engine compares rows."""
    ways = []
    for i in range(len(names)):
        last = i == len(names) - 1
        same = [f"{n} = {literal(v, engine)}" for n, v in zip(names[:i], bound)]
        ways.append(" AND ".join([*same, f"{names[i]} {'>=' if last else '>'} {literal(bound[i], engine)}"]))
    return ways[0] if len(ways) == 1 else "(" + " OR ".join(f"({w})" for w in ways) + ")"


def _before(names: Sequence[str], bound: Sequence, engine: str) -> str:
    ways = []
    for i in range(len(names)):
        same = [f"{n} = {literal(v, engine)}" for n, v in zip(names[:i], bound)]
        ways.append(" AND ".join([*same, f"{names[i]} < {literal(bound[i], engine)}"]))
    return ways[0] if len(ways) == 1 else "(" + " OR ".join(f"({w})" for w in ways) + ")"


def key_predicates(key: str | Sequence[str], bounds: Sequence[tuple], engine: str, with_nulls: bool = True) -> list[str]:
    """One SQL predicate per chunk ``(low, high)``; a key of several columns has tuples as
    bounds. First and last are open, so rows that come in outside the planned bounds are
    still read; null keys go with the first."""
    keys = [key] if isinstance(key, str) else list(key)
    names, out = [quote(k, engine) for k in keys], []
    whole = lambda bound: bound if len(keys) > 1 else (bound,)
    absent = " OR ".join(f"{name} IS NULL" for name in names)
    for i, (low, high) in enumerate(bounds):
        parts = ([_from(names, whole(low), engine)] if i else []) + ([_before(names, whole(high), engine)] if i < len(bounds) - 1 else [])
        text = " AND ".join(parts) or "1 = 1"
        out.append(f"({text} OR {absent})" if with_nulls and i == 0 and parts else text)
    return out


def read_partitioned(spark: SparkSession, opts: dict[str, str], table: str, key: str | Sequence[str], bounds: Sequence[tuple], engine: str) -> DataFrame:
    """One task per key range."""
    rest = {k: v for k, v in opts.items() if k != "url"}
    return spark.read.jdbc(opts["url"], quote_table(table, engine), predicates=key_predicates(key, bounds, engine), properties=rest)


def read_catalog(spark: SparkSession, opts: dict[str, str], engine: str, part: str) -> DataFrame:
    return spark.read.format("jdbc").options(**opts).option("query", CATALOG_QUERIES[engine.upper()][part]).load()


def read_preview(spark: SparkSession, opts: dict[str, str], table: str, key: str, limit: int, engine: str) -> DataFrame:
    """Few rows: the limit goes to the database as a sub-query."""
    rows = {
        "SQL_SERVER": f"select top {limit} * from {quote_table(table, engine)} order by {quote(key, engine)}",
        "ORACLE": f"select * from {quote_table(table, engine)} order by {quote(key, engine)} fetch first {limit} rows only",
    }.get(engine.upper(), f"select * from {quote_table(table, engine)} order by {quote(key, engine)} limit {limit}")
    return spark.read.format("jdbc").options(**opts).option("query", rows).load()


def append(df: DataFrame, opts: dict[str, str], table: str, engine: str, batch_rows: int = 10_000) -> None:
    rest = {k: v for k, v in opts.items() if k != "url"} | {"batchsize": str(batch_rows)}
    df.write.mode("append").jdbc(opts["url"], quote_table(table, engine), properties=rest)


def column_types(schema: T.StructType, names: dict[str, str]) -> str:
    """``createTableColumnTypes`` text; names maps Spark types to the engine's."""
    return ", ".join(f"{f.name} {names.get(f.dataType.simpleString(), f.dataType.simpleString())}" for f in schema.fields)
