"""Counts, checksums and key-level differences between two tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


# Bits of a double's mantissa; from here on every double is a whole number.
_MANTISSA = 2.0**53


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact rows per table; a Parquet count reads no column."""
    return _union(
        [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    )


def approx_row_counts(spark, tables: dict[str, DataFrame | None]) -> DataFrame:
    """Cheap counts; null for a table that cannot be read. For Parquet the count
    comes from the file footers, so the cheap figure is also the exact one."""
    known = {n: df for n, df in tables.items() if df is not None}
    missing = [(n, None) for n, df in tables.items() if df is None]
    out = table_row_counts(known).withColumnRenamed("row_count", "estimated_rows")
    if missing:
        out = out.unionByName(spark.createDataFrame(missing, "table_name string, estimated_rows bigint"))
    return out


def compare_row_counts(source: DataFrame, target: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows on both sides per group, with ``mismatch`` and ``verified``."""
    group = F.struct(*by).alias("_group")  # a struct matches null groups too
    left = source.groupBy(group).agg(F.count(F.lit(1)).alias("source_rows"))
    right = target.groupBy(group).agg(F.count(F.lit(1)).alias("target_rows"))
    both = left.join(right, "_group", "full_outer").na.fill(0, ["source_rows", "target_rows"])
    differs = F.col("source_rows") != F.col("target_rows")
    return both.select("_group.*", "source_rows", "target_rows", differs.alias("mismatch"), (~differs).alias("verified"))


def _double_text(value: Column) -> Column:
    """The exact value, by arithmetic that loses no bit: the whole part, then the
    fraction in steps of 53 bits until nothing is left. So other engines can spell
    it too; only what lies beyond (2^53 and more, bits below 2^-106, not finite) is
    spelled by the engine itself, just as exactly."""
    size = F.abs(value)
    whole = F.floor(size)
    first = (size - whole) * _MANTISSA
    rest = (first - F.floor(first)) * _MANTISSA
    beyond = rest - F.floor(rest)
    tail = F.when(rest == 0, "").when(beyond == 0, F.concat(F.lit("."), F.floor(rest).cast("string"))).otherwise(
        F.concat(F.lit("."), F.floor(rest).cast("string"), F.lit("."), beyond.cast("string"))
    )
    sign = F.when(value < 0, "-").otherwise("")
    exact = F.concat(sign, whole.cast("string"), F.lit("."), F.floor(first).cast("string"), tail)
    return F.when(size < _MANTISSA, exact).otherwise(value.cast("string"))


def canonical_text(column: Column, data_type: T.DataType) -> Column:
    """One exact spelling per value, which other engines can give too: floating point
    by its bits, times as microseconds since 1970, texts led by their length, and
    nested values as the count of their parts and the parts, each spelled this way.
    Maps are spelled in the order of their entries' texts. Null stays null."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return _double_text(column.cast("double"))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        epoch = F.lit("1970-01-01 00:00:00").cast(data_type)
        return F.timestamp_diff("MICROSECOND", epoch, column).cast("string")
    if isinstance(data_type, (T.NumericType, T.DateType, T.BooleanType)):
        return column.cast("string")
    if isinstance(data_type, T.StructType):
        return F.when(column.isNotNull(), _parts_text([_part(column[f.name], f.dataType) for f in data_type.fields]))
    if isinstance(data_type, T.ArrayType):
        return _list_text(F.transform(column, lambda item: _part(item, data_type.elementType)))
    if isinstance(data_type, T.MapType):
        entry = lambda e: F.concat(_part(e["key"], data_type.keyType), F.lit("|"), _part(e["value"], data_type.valueType))
        return _list_text(F.array_sort(F.transform(F.map_entries(column), entry)))
    text = F.hex(column) if isinstance(data_type, T.BinaryType) else column.cast("string")
    return F.concat(F.length(text).cast("string"), F.lit(":"), text)


def _part(column: Column, data_type: T.DataType) -> Column:
    return F.coalesce(canonical_text(column, data_type), F.lit("-"))


def _parts_text(parts: Sequence[Column]) -> Column:
    return F.concat(F.lit("["), F.concat_ws("|", *parts), F.lit("]"))


def _list_text(parts: Column) -> Column:
    return F.concat(F.array_size(parts).cast("string"), F.lit("["), F.array_join(parts, "|"), F.lit("]"))


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """All fields in one text that no other row content can spell: fields end at a
    bar, texts (which may hold bars) are led by their length, lists by their count,
    null is a lone dash."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.concat_ws("|", *[_part(F.col(f"`{name}`"), types[name]) for name in columns or df.columns])


def _with_double_parts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The parts of ``_double_text`` for whole columns, each made once in a projection of
    its own: inside one expression every branch would work them out again."""
    size, whole, first, first_part, rest, rest_part = (lambda c, part=part: f"_{part}_{c}" for part in ("size", "whole", "first", "ones", "rest", "twos"))
    col = lambda name: F.col(f"`{name}`")
    df = df.withColumns({size(c): F.abs(col(c).cast("double")) for c in names})
    df = df.withColumns({whole(c): F.floor(col(size(c))) for c in names})
    df = df.withColumns({first(c): (col(size(c)) - col(whole(c))) * _MANTISSA for c in names})
    df = df.withColumns({first_part(c): F.floor(col(first(c))) for c in names})
    df = df.withColumns({rest(c): (col(first(c)) - col(first_part(c))) * _MANTISSA for c in names})
    return df.withColumns({rest_part(c): F.floor(col(rest(c))) for c in names})


def _double_text_of_parts(name: str) -> Column:
    """``_double_text`` from the columns that ``_with_double_parts`` made."""
    size, whole, ones, rest, twos = (F.col(f"`_{part}_{name}`") for part in ("size", "whole", "ones", "rest", "twos"))
    value = F.col(f"`{name}`").cast("double")
    beyond = rest - twos
    dot = F.lit(".")
    tail = F.when(rest == 0, "").otherwise(F.concat(dot, twos.cast("string"), F.when(beyond == 0, "").otherwise(F.concat(dot, beyond.cast("string")))))
    sign = F.when(value < 0, "-").otherwise("")
    return F.when(size < _MANTISSA, F.concat(sign, whole.cast("string"), dot, ones.cast("string"), tail)).otherwise(value.cast("string"))


def with_row_text(df: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Adds ``row_text`` as a column. Doubles are taken apart in projections before it,
    which is several times faster."""
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = list(columns or df.columns)
    doubles = [c for c in dict.fromkeys(wanted) if isinstance(types[c], (T.DoubleType, T.FloatType))]
    parts = [F.coalesce(_double_text_of_parts(c), F.lit("-")) if c in doubles else _part(F.col(f"`{c}`"), types[c]) for c in wanted]
    return (_with_double_parts(df, doubles) if doubles else df).withColumn(name, F.concat_ws("|", *parts))


def table_checksum(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and an order-free sum of row digests, portable between engines.

    All 128 bits of each MD5 count: four 32-bit parts are summed apart, each in two
    16-bit halves, which fit a long for any row count. The four sums make the checksum.
    Everything is partially aggregated before the only shuffle.
    """
    digest = with_row_text(df, "_text", columns).select(*by, F.md5("_text").alias("_digest"))
    parts = digest.select(*by, *[F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"_{k}") for k in range(4)])
    halves = [F.sum(half).alias(f"_{k}_{name}") for k in range(4) for name, half in (("high", F.shiftright(f"_{k}", 16)), ("low", F.col(f"_{k}").bitwiseAND(F.lit(0xFFFF))))]
    sums = parts.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), *halves)
    total = [F.coalesce(F.col(f"_{k}_high").cast("decimal(24,0)") * 65536 + F.col(f"_{k}_low"), F.lit(0)).cast("decimal(38,0)").cast("string") for k in range(4)]
    return sums.select(*by, "row_count", F.concat_ws("-", *total).alias("checksum"))


def fast_checksum(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Same use inside Spark only: a sum of 64-bit hashes, no text is built. A sum tells
    repeated rows apart, which xor would cancel."""
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.sum(digest.cast("decimal(38,0)")).alias("checksum"))


def _print_of(column: Column, data_type: T.DataType) -> Column:
    """Fixed-width values as they are, long ones as a 64-bit hash (null stays null)."""
    if isinstance(data_type, (T.NumericType, T.DatetimeType, T.BooleanType)):
        return column
    if not isinstance(data_type, (T.StringType, T.BinaryType)):
        column = canonical_text(column, data_type)  # maps have no hash of their own
    return F.when(column.isNotNull(), F.xxhash64(column))


def diff_tables(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: MATCH, CHANGED with the names of the changed columns,
    MISSING_IN_TARGET or EXTRA_IN_TARGET.

    One shuffle of each side that carries the key and at most eight bytes per
    column, whatever the width of the texts. Keys are unique on each side; tables
    without such a key go to ``diff_keyless``.
    """
    types = {f.name: f.dataType for f in source.schema.fields}
    values = [c for c in source.columns if c not in keys]

    def side(df: DataFrame, tag: str) -> DataFrame:
        prints = [_print_of(F.col(f"`{c}`"), types[c]).alias(f"{tag}_{i}") for i, c in enumerate(values)]
        return df.select(F.struct(*keys).alias("_key"), *prints, F.lit(True).alias(f"{tag}_here"))

    both = side(source, "s").join(side(target, "t"), "_key", "full_outer")
    changed = F.array_compact(
        F.array(*[F.when(~F.col(f"s_{i}").eqNullSafe(F.col(f"t_{i}")), F.lit(c)) for i, c in enumerate(values)])
    )
    status = (
        F.when(F.col("t_here").isNull(), "MISSING_IN_TARGET")
        .when(F.col("s_here").isNull(), "EXTRA_IN_TARGET")
        .when(F.size(changed) > 0, "CHANGED")
        .otherwise("MATCH")
    )
    names = F.when(status == "CHANGED", F.array_join(changed, ",")).otherwise(F.lit(""))
    return both.select("_key.*", status.alias("diff_status"), names.alias("changed_columns"))


def diff_keyless(source: DataFrame, target: DataFrame) -> DataFrame:
    """Row contents whose number of copies differs between the sides.

    Copies are counted before the shuffle, so a content that makes up a third of
    the table costs one row per task.
    """
    sides = _union(
        [
            with_row_text(df, "_text", source.columns).select(F.md5("_text").alias("row_hash"), F.lit(weight).alias("weight"))
            for df, weight in ((source, 1), (target, -1))
        ]
    )
    count = lambda sign: F.sum(F.when(F.col("weight") == sign, 1).otherwise(0)).alias
    return (
        sides.groupBy("row_hash")
        .agg(count(1)("source_copies"), count(-1)("target_copies"))
        .where(F.col("source_copies") != F.col("target_copies"))
    )


_FIXED_BYTES = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def value_bytes(column: Column, data_type: T.DataType) -> Column:
    """Bytes of one value: texts by their length, numbers by their width, arrays,
    maps and structs by what they hold. A null counts its width, or nothing."""
    zero = F.lit(0).cast("bigint")
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column).cast("bigint"), zero)
    if isinstance(data_type, T.StructType):
        return reduce(lambda a, b: a + b, [value_bytes(column[f.name], f.dataType) for f in data_type.fields], zero)
    if isinstance(data_type, T.MapType):
        keys, values = T.ArrayType(data_type.keyType), T.ArrayType(data_type.valueType)
        return value_bytes(F.map_keys(column), keys) + value_bytes(F.map_values(column), values)
    if isinstance(data_type, T.ArrayType):
        if type(data_type.elementType) in _FIXED_BYTES or isinstance(data_type.elementType, (T.NumericType, T.DatetimeType)):
            each = _FIXED_BYTES.get(type(data_type.elementType), 8)
            return F.coalesce(F.array_size(column).cast("bigint"), zero) * each
        held = F.aggregate(column, zero, lambda total, item: total + value_bytes(item, data_type.elementType))
        return F.coalesce(held, zero)
    return F.lit(_FIXED_BYTES.get(type(data_type), 8)).cast("bigint")


def size_estimate(tables: dict[str, DataFrame], rows_per_second: float) -> DataFrame:
    """Rows, bytes of the values and copy seconds per table, one pass each."""
    parts = []
    for name, df in tables.items():
        width = reduce(lambda a, b: a + b, [value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
        parts.append(
            df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(width), F.lit(0)).cast("bigint").alias("estimated_bytes")).select(
                F.lit(name).alias("table_name"),
                "row_count",
                "estimated_bytes",
                F.ceil(F.col("row_count") / F.lit(float(rows_per_second))).cast("bigint").alias("estimated_seconds"),
            )
        )
    return _union(parts)
