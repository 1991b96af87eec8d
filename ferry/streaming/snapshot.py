"""A table's load taken span by span of its keys while its changes arrive.

Every loaded row keeps a mark: the log position noted before its span was read. What the
log gained while the span was read may show in the rows or not; it lies above the mark and
is applied over them, and what lies below is in the rows already. So spans and batches of
changes may reach the target in any order, and the source is never stopped or locked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ferry.functions.numbers import LSN_BEFORE_ALL, is_lsn, lsn_rank
from ferry.plans.chunks import in_row_ranges
from ferry.plans.copy import CopyPlan, copy_pending_chunks, read_copy
from ferry.sources import target as store

#: First and last key (or number of a key range) of a span; None leaves that end open.
Span = tuple[int | None, int | None]


def last_position(changes: DataFrame, base: int = 16) -> str | None:
    """The greatest log position, None for a log without one."""
    known = changes.where(is_lsn(F.col("lsn"), base))
    return known.agg(F.max_by("lsn", lsn_rank(F.col("lsn"), base))).first()[0]


def key_spans(source: DataFrame, plan: CopyPlan, spans: int) -> list[Span]:
    """About ``spans`` spans that end where chunks end. Both outer ends are open, so a key
    that comes in later has a span as well."""
    if plan.bounds is not None:
        low, high, stride = 0, len(plan.bounds), 1
    else:
        stride = plan.stride
        low, high = source.agg(F.min(plan.key), F.max(plan.key)).first()
        if low is None:
            return [(None, None)]
        low, high = (end // stride * stride for end in (low, high))
    width = -(-((high - low) // stride + 1) // spans) * stride
    starts = list(range(low, high + 1, width))
    return list(zip([None, *starts[1:]], [*[at - 1 for at in starts[1:]], None], strict=True))


def _rows_of_span(source: DataFrame, plan: CopyPlan, span: Span) -> DataFrame:
    """Rows without a key belong to the first span, where the copy holds them back."""
    low, high = span
    keyless = F.lit(False)
    for name in plan.key_columns:
        keyless = keyless | F.col(name).isNull()
    if plan.bounds is not None:
        bounds = list(plan.bounds)
        found = in_row_ranges(source, plan.key_columns, bounds, 0 if low is None else low, len(bounds) if high is None else high)
        return found.unionByName(source.where(keyless)) if low is None else found
    key = F.col(plan.key)
    inside: Column = F.lit(True) if low is None else key >= low
    inside = inside if high is None else inside & (key <= high)
    return source.where(inside | keyless) if low is None else source.where(inside)


def load_span(spark: SparkSession, source: DataFrame, root: str, plan: CopyPlan, span: Span, mark: str | None, asof: str) -> None:
    """Copy the chunks of one span that are not complete yet. ``mark`` must have been
    noted before ``source`` is read. A chunk that was complete keeps its rows and their
    mark; one that failed or was cut off is read anew, under the new mark."""
    rows = _rows_of_span(source, plan, span).withColumn("_mark", F.lit(mark).cast("string"))
    copy_pending_chunks(spark, rows, root, plan, f"span-{'open' if span[0] is None else span[0]}", asof)


def load_spans(
    spark: SparkSession, source: DataFrame, root: str, plan: CopyPlan, spans: Sequence[Span], position: Callable[[], str | None], asof: str,
    after: Callable[[Span], None] | None = None,
) -> None:
    """Load all spans, one after the other. ``position`` tells the end of the log now;
    changes must be captured from the position of the first call on, or earlier. ``after``
    runs when a span is stored, for instance to apply what has come in meanwhile."""
    for span in spans:
        load_span(spark, source, root, plan, span, position(), asof)
        if after:
            after(span)


def loaded_rows(spark: SparkSession, root: str, base: int = 16) -> DataFrame:
    """Rows of the complete chunks with the control columns of a replicated target. A mark
    of None lies before any position."""
    rows = read_copy(spark, root).drop("_chunk_id")
    return (
        rows.withColumn("_lsn", F.coalesce(lsn_rank(F.col("_mark"), base), F.lit(LSN_BEFORE_ALL)))
        .withColumn("_event_id", F.lit(-1).cast("bigint"))
        .withColumn("_deleted", F.lit(False))
        .drop("_mark")
    )


def apply_load(spark: SparkSession, root: str, into: str, keys: Sequence[str], batch: str, buckets: int | None = None, base: int = 16) -> int:
    """Bring the loaded rows into the target: one pass, however many spans there were.
    A stored row that a change above the mark has written, or deleted, stays as it is.
    ``batch`` names the content; apply again under another name when more chunks are
    complete. Keys are unique among the loaded rows (``CopyPlan.order`` chooses)."""
    return store.upsert(spark, into, loaded_rows(spark, root, base), keys, batch, guard=("_lsn", "_event_id"), buckets=buckets)
