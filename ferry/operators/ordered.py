"""Work that depends on row order: newest per key, positions, running totals.

A window over one big group runs in a single task. Here the rows are first cut
into ordered blocks (a range shuffle on the order columns, so a hot group spreads
over many blocks), each block is scanned on its own, and the totals of the blocks
before it are added. The carried totals are one row per (group, block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ferry.session import fresh_dir, parallelism

_LOW_BITS = (1 << 33) - 1
# Spark's own bound for rank filters below a shuffle, and the parts used above it.
_PUSHED_RANKS, _PARTS = 1000, 32


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row of each key. The rank limit runs before the shuffle too, so a
    hot key sends one row per map task."""
    return newest_n(df, keys, [F.col(c).desc() for c in order], 1).drop("row_rank")


def newest_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the given order. Spark pushes a small rank
    filter below the shuffle as a per-task limit; beyond that limit a hot key is
    ranked in parts first, so that one task sorts at most ``n`` rows of each part."""
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    if n > _PUSHED_RANKS:
        parted = df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(_PARTS)))
        df = parted.withColumn("row_rank", rank(*keys, "_part")).where(F.col("row_rank") <= n).drop("_part", "row_rank")
    return df.withColumn("row_rank", rank(*keys)).where(F.col("row_rank") <= n)


def older_than_newest_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, id_column: str) -> DataFrame:
    """All rows but the ``n`` newest of each key, without ranking the whole key."""
    kept = newest_n(df, keys, order, n).select(id_column)
    return df.join(kept, id_column, "left_anti")


def ordered_blocks(df: DataFrame, order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Rows in global order, tagged with ``_block`` and ``_pos`` (place in block).

    Written to the shared folder: the cut points come from sampling, so they must
    be fixed before two passes can rely on them. ``order`` should be unique per
    row; add tie-breaking columns so equal keys can be split.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, "ordered")
    (
        df.repartitionByRange(blocks or parallelism(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("_block", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS)))
        .write.parquet(path)
    )
    return spark.read.parquet(path)


def row_positions(df: DataFrame, order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """0-based position of each row in the global order, as column ``position``."""
    tagged = ordered_blocks(df, order, blocks)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block: the block count is the session's partition setting.
    offsets = tagged.groupBy("_block").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    return (
        tagged.join(F.broadcast(offsets), "_block")
        .withColumn("position", F.col("_offset") + F.col("_pos"))
        .drop("_block", "_pos", "_offset")
    )


# Groups are compared as a struct of their columns: unlike a bare column, a struct
# that holds a null equals another one, so a null group keeps its rows in the joins.
def _keyed(tagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tagged.withColumn("_key", F.struct(*keys))


def _inside():
    return Window.partitionBy("_key", "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)


def _earlier():
    return Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(tagged: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Inclusive running sum of a column per key over tagged blocks."""
    tagged = _keyed(tagged, keys)
    totals = tagged.groupBy("_key", "_block").agg(F.sum(value).alias("_total"))
    carried = totals.select("_key", "_block", F.coalesce(F.sum("_total").over(_earlier()), F.lit(0)).alias("_carried"))
    local = tagged.withColumn("_local", F.coalesce(F.sum(value).over(_inside()), F.lit(0)))
    summed = local.join(carried, ["_key", "_block"]).withColumn(name, F.col("_local") + F.col("_carried"))
    return summed.drop("_key", "_local", "_carried")


def cumulative_progress(rows: DataFrame, key: str, order: Sequence[str], done: str, totals: DataFrame | None = None) -> DataFrame:
    """Rows copied so far and percent of the key's ``total_rows``, in order.
    Without given totals they are those of the rows themselves."""
    tagged = ordered_blocks(rows, [*order])
    if totals is None:
        totals = tagged.groupBy(key).agg(F.sum(done).alias("total_rows"))
    totals = totals.select(F.struct(key).alias("_key"), "total_rows")
    counted = _keyed(running_sum(tagged, [key], done, "rows_so_far"), [key]).join(totals, "_key", "left")
    share = F.col("rows_so_far") * 100.0 / F.nullif(F.col("total_rows").cast("double"), F.lit(0.0))
    percent = F.when(F.col("total_rows") > 0, F.least(share, F.lit(100.0))).otherwise(F.lit(100.0))
    return counted.withColumn("percent_so_far", percent).drop("_key", "_block", "_pos")


def consecutive_errors(polls: DataFrame, key: str, order: Sequence[str], outcome: str, limit: int) -> DataFrame:
    """Length of the failure run at each poll. ``APPLIED`` ends a run, ``EMPTY``
    neither ends nor lengthens it.

    Inside a block the run is the failures so far minus their number at the last
    applied batch. A block that has not seen one yet adds the run it inherits:
    failures of all earlier blocks minus their number at the last applied batch
    before it, which only takes two figures per (key, block).
    """
    tagged = _keyed(ordered_blocks(polls, [*order]), [key])
    failed = (F.col(outcome) == "ERROR").cast("bigint")
    local = tagged.withColumn("_failed", F.sum(failed).over(_inside()))
    at_reset = F.when(F.col(outcome) == "APPLIED", F.col("_failed"))
    local = local.withColumn("_reset", F.max(at_reset).over(_inside()))
    blocks = local.groupBy("_key", "_block").agg(F.max("_failed").alias("_sum"), F.max("_reset").alias("_last"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_sum").over(_earlier()), F.lit(0)))
    base = F.max(F.col("_before") + F.col("_last")).over(_earlier())
    blocks = blocks.select("_key", "_block", (F.col("_before") - F.coalesce(base, F.lit(0))).alias("_inherited"))
    run = F.when(F.col("_reset").isNotNull(), F.col("_failed") - F.col("_reset")).otherwise(F.col("_failed") + F.col("_inherited"))
    return (
        local.join(blocks, ["_key", "_block"])
        .withColumn("error_run", run)
        .withColumn("tripped", F.col("error_run") >= limit)
        .drop("_key", "_block", "_pos", "_failed", "_reset", "_inherited")
    )
