"""Cutting tables into chunks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ferry.functions.numbers import chunk_count, fixed_chunk_rows, planned_chunk_rows
from ferry.functions.text import offset_chunk_id, ordinal_chunk_id


_STEP = 10_000


def _with_ordinals(df: DataFrame, count: Column) -> DataFrame:
    """A row per ``_i`` from 0 to count-1, none when count is 0. Counted out in two
    steps, so a table of millions of chunks makes no array of that length."""
    first = F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1, F.lit(_STEP).cast("bigint"))))
    last = F.least(F.col("_first") + (_STEP - 1), F.col("_count") - 1)
    return (
        df.select("*", count.alias("_count"), first.alias("_first"))
        .select("*", F.explode(F.sequence("_first", last)).alias("_i"))
        .drop("_count", "_first")
    )


def plan_chunks(tables: DataFrame, migration: Column) -> DataFrame:
    """Row ranges for (table_name, row_count) rows, about ten per table. An empty
    table still gets one chunk, of no rows."""
    size = planned_chunk_rows(F.col("row_count"))
    sized = tables.withColumn("_size", size)
    cut = _with_ordinals(sized, chunk_count(F.col("row_count"), F.col("_size"), when_empty=1))
    start = F.col("_i") * F.col("_size")
    empty = F.col("row_count") <= 0
    return cut.select(
        ordinal_chunk_id(migration, F.col("table_name"), F.col("_i")).alias("chunk_id"),
        "table_name",
        start.alias("start_row"),
        F.when(empty, F.lit(0).cast("bigint")).otherwise(F.least(start + F.col("_size"), F.col("row_count")) - 1).alias("end_row"),
        F.when(empty, F.lit(0).cast("bigint")).otherwise(F.least(F.col("_size"), F.col("row_count") - start)).alias("estimated_rows"),
    )


def plan_chunks_fixed(tables: DataFrame, migration: Column, size: int | None = None) -> DataFrame:
    """Offset/limit ranges of one size; the last is shorter, an empty table has none."""
    sized = tables.withColumn("_size", fixed_chunk_rows(F.lit(size).cast("bigint")))
    cut = _with_ordinals(sized, chunk_count(F.col("row_count"), F.col("_size")))
    start = F.col("_i") * F.col("_size")
    return cut.select(
        offset_chunk_id(migration, F.col("table_name"), start).alias("chunk_id"),
        "table_name",
        start.alias("row_offset"),
        F.least(F.col("_size"), F.col("row_count") - start).alias("row_limit"),
        F.col("row_count").alias("total_rows"),
    )


def plan_key_ranges(df: DataFrame, key: str, chunks: int, accuracy: int | None = None) -> DataFrame:
    """Disjoint key ranges ``[low, high)`` of about equal row counts.

    The inner bounds are approximate quantiles, so a dense stretch of keys gets
    narrow ranges. Their accuracy grows with the number of chunks. The first range also takes nulls and all below, the last all
    above: together they cover every row.
    """
    none = F.array().cast(f"array<{df.schema[key].dataType.simpleString()}>")
    shares = [i / chunks for i in range(1, chunks)] or [0.5]
    cuts = F.array_distinct(F.percentile_approx(key, shares, accuracy or max(10_000, 20 * chunks))) if chunks > 1 else F.first(none)
    bounds = df.agg(cuts.alias("_cuts")).select(F.coalesce("_cuts", none).alias("_cuts"))
    ranges = F.transform(
        F.sequence(F.lit(0), F.size("_cuts")),
        lambda i: F.struct(
            i.cast("int").alias("chunk_no"),
            F.try_element_at("_cuts", F.nullif(i, F.lit(0))).alias("low"),
            F.when(i < F.size("_cuts"), F.try_element_at("_cuts", i + 1)).alias("high"),
        ),
    )
    return bounds.select(F.inline(ranges))


def range_bounds(ranges: DataFrame) -> list[tuple]:
    """The planned bounds as a list, one entry per chunk."""
    return [(r.low, r.high) for r in ranges.orderBy("chunk_no").collect()]


def scan_ranges(df: DataFrame, key: str, bounds: list[tuple]) -> DataFrame:
    """The table read range by range, each with its bounds in the scan. The open
    first range also takes null keys."""
    parts = []
    for i, (low, high) in enumerate(bounds):
        part = df if low is None else df.where(F.col(key) >= F.lit(low))
        if high is not None:
            below = F.col(key) < F.lit(high)
            part = part.where(below | F.col(key).isNull() if i == 0 else below)
        parts.append(part)
    return reduce(lambda a, b: a.unionByName(b), parts)


#: Sampled keys for each planned range.
SAMPLED = 200


def plan_row_ranges(df: DataFrame, keys: Sequence[str], chunks: int, sampled: int = SAMPLED) -> DataFrame:
    """(chunk_no, low): the lower bounds of ranges of about equal row counts, for keys of
    any type that has an order, one column or several, compared one after the other.

    Bounds come from about ``chunks * sampled`` keys, taken by hash so that all copies of a
    key are in or out and weigh by their number: a hot key gets a range of its own. The
    first range has no bound and no row here; rows with a null key are in no range.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    present = df.where(whole).select(F.struct(*keys).alias("low"))
    distinct = present.agg(F.approx_count_distinct(F.xxhash64("low"))).first()[0]
    share = max(1, distinct // max(1, chunks * sampled))
    counted = present.where(F.pmod(F.xxhash64("low"), F.lit(share)) == 0).groupBy("low").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.select("low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    numbered = placed.withColumn("chunk_no", F.floor(F.col("before") * chunks / F.col("total")))
    first = numbered.groupBy("chunk_no").agg(F.min("low").alias("low")).where("chunk_no > 0")
    return first.select((F.row_number().over(Window.orderBy("low"))).alias("chunk_no"), "low")


def row_bounds(ranges: DataFrame) -> list[tuple]:
    """The lower bounds in order, at most one per planned range."""
    return [tuple(r.low) for r in ranges.orderBy("chunk_no").collect()]


def _bound(bound: tuple, types: Sequence) -> Column:
    return F.struct(*[F.lit(v).cast(t) for v, t in zip(bound, types, strict=True)])


def range_chunk(df: DataFrame, keys: Sequence[str], bounds: list[tuple]) -> Column:
    """Number of the range that a row's key lies in, found by binary search: the steps are
    the powers of two of the number of bounds. Null where a key is null."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    if not bounds:
        return F.when(whole, F.lit(0).cast("bigint"))
    types = [df.schema[k].dataType for k in keys]
    key = F.struct(*[F.col(k).alias(f"col{i + 1}") for i, k in enumerate(keys)])
    listed = F.array(*[_bound(b, types) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])

    def step(at: Column, width: Column) -> Column:
        here = at + width
        return F.when((here <= len(bounds)) & F.coalesce(F.get(listed, here - 1) <= key, F.lit(False)), here).otherwise(at)

    return F.when(whole, F.aggregate(steps, F.lit(0), step).cast("bigint"))


def in_row_ranges(df: DataFrame, keys: Sequence[str], bounds: list[tuple], first: int, last: int) -> DataFrame:
    """Rows of the ranges ``first`` to ``last``. The first key column's span is a plain
    filter, which reaches the scan; the whole key decides."""
    types = [df.schema[k].dataType for k in keys]
    key = F.struct(*[F.col(k).alias(f"col{i + 1}") for i, k in enumerate(keys)])
    rows = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    if first > 0:
        low = bounds[first - 1]
        rows = rows.where((F.col(keys[0]) >= F.lit(low[0]).cast(types[0])) & (key >= _bound(low, types)))
    if last < len(bounds):
        high = bounds[last]
        rows = rows.where((F.col(keys[0]) <= F.lit(high[0]).cast(types[0])) & (key < _bound(high, types)))
    return rows


def stride_chunk(key: Column, stride: int) -> Column:
    """Chunk number of a dense numeric key."""
    return F.floor(key / F.lit(stride)).cast("bigint")


def pending_chunks(chunks: DataFrame, ledger_now: DataFrame) -> DataFrame:
    """Chunks the ledger does not show as completed."""
    done = ledger_now.where(F.col("status") == "COMPLETED").select("chunk_id")
    return chunks.join(done, "chunk_id", "left_anti")
