"""Sizes, percentages and log positions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ferry.schemas import LSN

# Chunk size limits.
PLANNER_MIN_ROWS = 1000
PLANNER_MAX_ROWS = 100_000
PLANNER_TARGET_CHUNKS = 10
FIXED_DEFAULT_ROWS = 10_000
FIXED_MAX_ROWS = 50_000


def planned_chunk_rows(rows: Column) -> Column:
    """About ten chunks per table, between 1,000 and 100,000 rows each."""
    tenth = F.floor(rows / F.lit(PLANNER_TARGET_CHUNKS))
    return F.least(F.lit(PLANNER_MAX_ROWS), F.greatest(F.lit(PLANNER_MIN_ROWS), tenth)).cast("bigint")


def fixed_chunk_rows(asked: Column) -> Column:
    """A requested size held to 1 … 50,000; null or 0 means the default."""
    wanted = F.when(asked.isNull() | (asked == 0), F.lit(FIXED_DEFAULT_ROWS)).otherwise(asked)
    return F.greatest(F.lit(1), F.least(wanted, F.lit(FIXED_MAX_ROWS))).cast("bigint")


def chunk_count(rows: Column, size: Column, when_empty: int = 0) -> Column:
    return F.when(rows > 0, F.ceil(rows / size)).otherwise(F.lit(when_empty)).cast("bigint")


def progress_percent(done: Column, total: Column, when_empty: float = 100.0) -> Column:
    share = done.cast("double") * 100.0 / F.nullif(total.cast("double"), F.lit(0.0))
    return F.when(total > 0, F.least(share, F.lit(100.0))).otherwise(F.lit(float(when_empty)))


def _halves(lsn: Column, base: int) -> list[Column]:
    return [F.conv(F.split_part(lsn, F.lit("/"), F.lit(i)), base, 10).try_cast("bigint") for i in (1, 2)]


def lsn_number(lsn: Column, base: int = 16) -> Column:
    """``hi/lo`` log position as a number that sorts in log order, however long the
    halves are; null where a half has more than 63 bits."""
    hi, lo = (half.cast("decimal(19,0)") for half in _halves(lsn, base))
    return (hi * F.lit(2**32).cast("decimal(11,0)") + lo).cast(LSN)


def lsn_rank(lsn: Column, base: int = 16) -> Column:
    """The same order as a plain long, for sorting and comparing: the number less
    2^63, which is what keeps all 64 bits of it in range. Null where a half has
    more than 32 bits."""
    hi, lo = _halves(lsn, base)
    fits = hi.between(0, 2**32 - 1) & lo.between(0, 2**32 - 1)
    return F.when(fits, (hi - F.lit(2**31)) * F.lit(2**32) + lo)


def is_lsn(lsn: Column, base: int = 16) -> Column:
    """Two halves of digits of the base that fit 32 bits each."""
    digits = {10: "[0-9]+", 16: "[0-9A-Fa-f]+"}[base]
    return F.coalesce(lsn.rlike(rf"\A{digits}/{digits}\z") & lsn_rank(lsn, base).isNotNull(), F.lit(False))


LSN_BEFORE_ALL = -(2**63)
