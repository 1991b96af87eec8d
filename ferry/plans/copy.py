"""Copying a table from end to end.

Rows lie in ``rows/_held=B/_chunk_id=ID``: a chunk is a partition of its own, and a try
writes the partitions of its chunks anew (dynamic partition overwrite), so copying a chunk
again replaces it and touches no other. Held rows (those that break a rule) are written by
the same job. The ledger says which chunks count: readers see completed ones only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import timedelta
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ferry.functions.convert import convert_columns
from ferry.functions.numbers import progress_percent
from ferry.functions.text import offset_chunk_id
from ferry.operators import ledger as states, quality
from ferry.operators.ordered import latest_per_key
from ferry.plans.chunks import in_row_ranges, pending_chunks, plan_row_ranges, range_chunk, row_bounds, stride_chunk
from ferry.sources import files
from ferry.sources.tables import scan_chunk


@dataclass(frozen=True)
class CopyPlan:
    """What to copy and how. ``stride`` is the key width of a chunk, ``waves`` the number
    of parts that are stored and noted one after the other. With ``rules``, ``order`` says
    which row of a repeated key is loaded; without, the last one by ``order`` is.

    A dense numeric key is cut by its stride. Any other key, of one column or several in
    ``keys``, is cut at ``bounds`` (see ``ranged_plan``): a chunk is then named by the
    number of its range, and the stride is 1."""

    migration_id: int
    table: str
    key: str
    stride: int
    kinds: dict[str, str] = field(default_factory=dict)
    source_engine: str = "POSTGRESQL"
    target_engine: str = "POSTGRESQL"
    rules: Sequence[tuple[str, Column]] = ()
    order: str | None = None
    waves: int = 1
    keys: tuple[str, ...] = ()
    bounds: tuple[tuple, ...] | None = None

    @property
    def key_columns(self) -> list[str]:
        return list(self.keys or (self.key,))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.schema(states.LEDGER).parquet(path) if files.exists(spark, path) else None


def ranged_plan(spark: SparkSession, source: DataFrame, root: str, plan: CopyPlan, chunks: int) -> CopyPlan:
    """The plan with bounds for ``chunks`` ranges of its keys. They are made once and kept
    under ``root``: a later run must name its chunks alike."""
    keys, path = plan.key_columns, f"{root}/ranges"
    if not files.exists(spark, f"{path}/_SUCCESS"):
        plan_row_ranges(source, keys, chunks).coalesce(1).write.mode("overwrite").parquet(path)
    return replace(plan, keys=tuple(keys), stride=1, bounds=tuple(row_bounds(spark.read.parquet(path))))


def _chunk_start(rows: DataFrame, plan: CopyPlan) -> Column:
    if plan.bounds is not None:
        return range_chunk(rows, plan.key_columns, list(plan.bounds))
    return stride_chunk(F.col(plan.key), plan.stride) * plan.stride


def _chunk_id(plan: CopyPlan, start: Column) -> Column:
    """Rows without a key make a chunk of their own."""
    migration, table = F.lit(plan.migration_id), F.lit(plan.table)
    return F.coalesce(offset_chunk_id(migration, table, start), F.concat_ws("#", migration, table, F.lit("keyless")))


def with_chunk(rows: DataFrame, plan: CopyPlan) -> DataFrame:
    return rows.withColumn("_chunk_id", _chunk_id(plan, _chunk_start(rows, plan)))


def chunks_of(rows: DataFrame, plan: CopyPlan) -> DataFrame:
    """The table's chunks with their first key and the rows found in each."""
    counted = rows.select(_chunk_start(rows, plan).alias("chunk_start")).groupBy("chunk_start").agg(F.count(F.lit(1)).alias("row_count"))
    return counted.withColumn("chunk_id", _chunk_id(plan, F.col("chunk_start")))


class _Journal:
    """Appends chunk states; each entry is later than all before it."""

    def __init__(self, spark: SparkSession, root: str, plan: CopyPlan, asof: str):
        self.spark, self.path, self.plan = spark, f"{root}/ledger", plan
        known = read_ledger(spark, self.path)
        next_one = F.max("noted_at") + F.expr("interval 1 microsecond")
        start = F.lit(asof).cast("timestamp_ntz")
        row = (spark.range(1).select(start.alias("at")) if known is None else known.agg(F.greatest(start, next_one).alias("at"))).first()
        self.at, self.entries = row.at, 0

    def note(self, chunks: DataFrame, status: str, rows_done: Column | None = None, error: str | None = None) -> None:
        chunks.select(
            F.lit(self.plan.migration_id).cast("bigint").alias("migration_id"),
            "chunk_id",
            F.lit(self.plan.table).alias("table_name"),
            F.lit(status).alias("status"),
            (F.lit(0) if rows_done is None else rows_done).cast("bigint").alias("rows_done"),
            F.lit(error).cast("string").alias("error"),
            F.lit(self.at + timedelta(microseconds=self.entries)).cast("timestamp_ntz").alias("noted_at"),
        ).write.mode("append").parquet(self.path)
        self.entries += 1


def _rows_of(source: DataFrame, plan: CopyPlan, wave: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Source rows of a wave's chunks. The span of their keys goes to the scan as a
    plain filter; inside it a semi join on the chunk decides."""
    if low is None:
        return with_chunk(source.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in plan.key_columns])), plan)
    if plan.bounds is not None:
        found = in_row_ranges(source, plan.key_columns, list(plan.bounds), low, high)
    else:
        found = scan_chunk(source, plan.key, low, high + plan.stride)
    keyed = with_chunk(found, plan)
    return keyed.join(wave.select(F.col("chunk_id").alias("_chunk_id")), "_chunk_id", "left_semi")


def _checked_rows(source: DataFrame, plan: CopyPlan, wave: DataFrame, low: int | None, high: int | None, choose: bool = True) -> DataFrame:
    """A wave's rows as they are written, with ``_held``. ``choose`` is unset where no row
    of a repeated key has to be chosen."""
    rows = convert_columns(_rows_of(source, plan, wave, low, high), plan.kinds, plan.source_engine, plan.target_engine)
    rules = list(plan.rules) if low is not None else [*[quality.not_null(k) for k in plan.key_columns], *plan.rules]
    if choose and plan.order and not rules:
        rows = latest_per_key(rows, plan.key_columns, [plan.order])
    if plan.order and plan.rules and len(plan.key_columns) > 1:
        raise ValueError("rows of a repeated key are chosen for keys of one column")
    checked = quality.check_rows(rows, rules, plan.key if choose and plan.order and plan.rules else None, plan.order)
    return checked.withColumn("_held", F.size("reasons") > 0)


def _copy_wave(spark: SparkSession, source: DataFrame, root: str, plan: CopyPlan, wave: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Write one wave and return the rows stored per chunk, as counted in the target."""
    rows = _checked_rows(source, plan, wave, low, high).hint("rebalance", "_chunk_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_held", "_chunk_id").parquet(f"{root}/rows")
    chunk = wave.select("chunk_id")
    if not files.exists(spark, f"{root}/rows"):
        return chunk.withColumn("stored", F.lit(0))
    # Only file footers are read.
    loaded = spark.read.schema("_held boolean, _chunk_id string").parquet(f"{root}/rows").where(~F.col("_held"))
    counted = loaded.groupBy(F.col("_chunk_id").alias("chunk_id")).agg(F.count(F.lit(1)).alias("stored"))
    return chunk.join(counted, "chunk_id", "left").na.fill(0, ["stored"])


def _broken(source: DataFrame, plan: CopyPlan, chunks: DataFrame, low: int, high: int) -> dict[int, str]:
    """The chunks from ``low`` to ``high`` whose rows cannot be read, with the error. The
    span, which is known to fail as a whole, is halved until each stands alone; nothing is
    written."""
    halves = lambda low, middle, high: [(middle + plan.stride, high), (low, middle)]
    middle_of = lambda low, high: low + (high - low) // plan.stride // 2 * plan.stride
    spans, found = halves(low, middle_of(low, high), high), {}
    while spans:
        low, high = spans.pop()
        wave = chunks.where(F.col("chunk_start").between(low, high))
        try:
            _checked_rows(source, plan, wave, low, high, choose=False).write.format("noop").mode("overwrite").save()
        except Exception as error:
            if low == high:
                found[low] = str(error)
                continue
            spans += halves(low, middle_of(low, high), high)
    return found


def _note_columns(spark: SparkSession, root: str, rows: DataFrame) -> None:
    """Keeps the columns of the copy: those of earlier runs, then new ones."""
    known = {f.name: f for f in (_noted_columns(spark, root) or T.StructType()).fields}
    for field_ in rows.schema.fields:
        before = known.setdefault(field_.name, T.StructField(field_.name, field_.dataType))
        if before.dataType != field_.dataType:
            raise ValueError(f"column {field_.name} was copied as {before.dataType.simpleString()}, not {field_.dataType.simpleString()}")
    text = json.dumps(T.StructType(list(known.values())).jsonValue())
    spark.range(0, 1, 1, 1).select(F.lit(text).alias("value")).write.text(f"{root}/columns/{uuid.uuid4().hex}")


def _noted_columns(spark: SparkSession, root: str) -> T.StructType | None:
    if not files.folders(spark, f"{root}/columns/*"):
        return None
    noted = [T.StructType.fromJson(json.loads(r.value)) for r in spark.read.text(f"{root}/columns/*").collect()]
    return max(noted, key=lambda shape: len(shape.fields))


def _read_rows(spark: SparkSession, root: str) -> DataFrame:
    shape = _noted_columns(spark, root)
    if shape is None:
        raise ValueError(f"nothing copied under {root}")
    schema = T.StructType([*shape.fields, T.StructField("reasons", T.ArrayType(T.StringType())), T.StructField("_held", T.BooleanType()), T.StructField("_chunk_id", T.StringType())])
    return spark.read.schema(schema).parquet(f"{root}/rows") if files.exists(spark, f"{root}/rows") else spark.createDataFrame([], schema)


def read_copy(spark: SparkSession, root: str, chunks: DataFrame | None = None) -> DataFrame:
    """Copied rows with their ``_chunk_id``: those of all completed chunks, or only of the
    given ones (``chunk_id``), which is how rows go back to a checkpoint."""
    ledger = read_ledger(spark, f"{root}/ledger")
    if ledger is None:
        raise ValueError(f"nothing copied under {root}")
    done = states.current_ledger(ledger).where((F.col("status") == "COMPLETED") & (F.col("rows_done") > 0)).select("chunk_id")
    done = done if chunks is None else done.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return states.roll_back_rows(_read_rows(spark, root).where(~F.col("_held")).drop("_held", "reasons"), done)


def read_held(spark: SparkSession, root: str) -> DataFrame:
    """Rows that were not loaded, with the reasons."""
    return _read_rows(spark, root).where("_held").drop("_held")


def finished_by(ledger: DataFrame, checkpoint_at: str) -> DataFrame:
    """(chunk_id) of the chunks that were complete at a checkpoint's time."""
    before = ledger.where(F.col("noted_at") <= F.lit(checkpoint_at).cast("timestamp_ntz"))
    return states.current_ledger(before).where(F.col("status") == "COMPLETED").select("chunk_id")


def _clear(spark: SparkSession, root: str, chunks: DataFrame) -> None:
    """Removes what an unfinished try left of open chunks, so that a chunk which now holds
    no row of a kind shows none."""
    left = [path.rsplit("/", 1)[1].removeprefix("_chunk_id=") for path in files.folders(spark, f"{root}/rows/_held=*/_chunk_id=*")]
    if not left:
        return
    named = spark.createDataFrame([(unquote(name), name) for name in set(left)], "chunk_id string, name string")
    for r in named.join(chunks, "chunk_id", "left_semi").collect():
        for held in ("false", "true"):
            files.discard(spark, f"{root}/rows/_held={held}/_chunk_id={r.name}")


def copy_pending_chunks(spark: SparkSession, source: DataFrame, root: str, plan: CopyPlan, batch: str, asof: str) -> DataFrame:
    """Copy the chunks the ledger does not show as completed; returns the ledger.

    The open chunks are counted and noted as PENDING, copied in ``plan.waves`` spans of
    keys, and noted as RUNNING and then COMPLETED, wave by wave: what one wave stored
    stays whatever happens to the next. Where a wave fails, the chunks that cannot be
    read are searched by reading only; each is noted as FAILED with its error, and the
    spans between them are written. If all can be read, the wave is halved and written
    again. No number of failures ends the copy. Failed chunks are open in the next run.
    """
    journal = _Journal(spark, root, plan, asof)
    ledger = read_ledger(spark, journal.path)
    chunks = chunks_of(source, plan)
    if ledger is not None:
        chunks = pending_chunks(chunks, states.current_ledger(ledger))
    planned = f"{root}/plan/batch={batch}-{uuid.uuid4().hex[:12]}"
    chunks.withColumn("planned_at", F.lit(journal.at).cast("timestamp_ntz")).write.parquet(planned)
    chunks = spark.read.parquet(planned)
    ends = F.min("chunk_start").alias("low"), F.max("chunk_start").alias("high"), F.count(F.lit(1)).alias("n"), F.count("chunk_start").alias("keyed")
    span = chunks.agg(*ends).first()
    if not span.n:
        return ledger if ledger is not None else spark.createDataFrame([], states.LEDGER)
    _note_columns(spark, root, convert_columns(source, plan.kinds, plan.source_engine, plan.target_engine))
    _clear(spark, root, chunks)
    journal.note(chunks, "PENDING")
    waves = [(None, None)] if span.n > span.keyed else []
    if span.keyed:
        width = -(-((span.high - span.low) // plan.stride + 1) // plan.waves) * plan.stride
        waves += [(low, min(low + width - plan.stride, span.high)) for low in range(span.low, span.high + 1, width)]
    waves = waves[::-1]
    while waves:
        low, high = waves.pop()
        start = F.col("chunk_start")
        wave = chunks.where(start.isNull() if low is None else start.between(low, high))
        journal.note(wave, "RUNNING")
        try:
            journal.note(_copy_wave(spark, source, root, plan, wave, low, high), "COMPLETED", F.col("stored"))
        except Exception as error:
            if low is None or low == high:
                journal.note(wave, "FAILED", error=str(error))
                continue
            broken = _broken(source, plan, chunks, low, high)
            for at, told in sorted(broken.items()):
                journal.note(chunks.where(start == at), "FAILED", error=told)
            edges = [low - plan.stride, *sorted(broken), high + plan.stride] if broken else [low - plan.stride, high + plan.stride]
            between = [(a + plan.stride, b - plan.stride) for a, b in zip(edges[:-1], edges[1:]) if a + plan.stride < b]
            if not broken:
                middle = low + (high - low) // plan.stride // 2 * plan.stride
                between = [(low, middle), (middle + plan.stride, high)]
            waves += between[::-1]
    return read_ledger(spark, journal.path)


def planned_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows per chunk as counted by the last plan that held the chunk."""
    plans = spark.read.parquet(f"{root}/plan")
    return plans.groupBy("chunk_id").agg(F.max_by("row_count", "planned_at").alias("planned"))


def copy_table(spark: SparkSession, source: DataFrame, root: str, plan: CopyPlan, asof: str, batch: str = "copy-1") -> DataFrame:
    """Plan, copy, record, checkpoint; returns the table's progress row. The percentage
    is that of the rows planned: held rows and failed chunks keep it below 100."""
    ledger = states.current_ledger(copy_pending_chunks(spark, source, root, plan, batch, asof))
    done = F.col("status") == "COMPLETED"
    counted = (
        ledger.join(planned_rows(spark, root), "chunk_id", "left")
        .groupBy("migration_id", "table_name")
        .agg(
            F.coalesce(F.sum(F.when(done, F.col("rows_done"))), F.lit(0)).alias("rows_copied"),
            F.sum(F.coalesce("planned", "rows_done")).alias("total_rows"),
            F.count(F.lit(1)).alias("chunks_total"),
            F.count_if(done).alias("chunks_completed"),
            F.count_if(F.col("status") == "FAILED").alias("chunks_failed"),
        )
    )
    progress = counted.withColumn("rows_so_far", F.col("rows_copied"))
    states.checkpoints_of(progress, F.lit(asof).cast("timestamp_ntz")).write.mode("append").parquet(f"{root}/checkpoints")
    return counted.withColumn("progress_percent", progress_percent(F.col("rows_copied"), F.col("total_rows")))
