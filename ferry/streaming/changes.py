"""Change data capture: batch core and the streams around it."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ferry.functions.images import decode_image
from ferry.functions.numbers import LSN_BEFORE_ALL, is_lsn, lsn_number, lsn_rank
from ferry.functions.text import in_enum, normalise_enum
from ferry.operators.metrics import change_counts
from ferry.operators.ordered import latest_per_key, newest_n
from ferry.schemas import CHANGE_BATCH_ROWS, CHANGE_EVENT, CHANGE_OPERATIONS, MAX_CONSECUTIVE_ERRORS, MAX_LAG_SECONDS
from ferry.sources import target as store


# ---- reading and recording -------------------------------------------------

def change_source(spark: SparkSession, folder: str, fmt: str = "parquet", files_per_batch: int | None = None, schema: T.StructType = CHANGE_EVENT) -> DataFrame:
    """Change events that are dropped as files into a folder. A broker topic with
    the same columns takes this one's place where its connector is installed."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def record_changes(events: DataFrame, base: int = 16) -> tuple[DataFrame, DataFrame]:
    """Events fit to append, and rejected ones with the reasons. ``base`` is that of
    the digits of log positions: 16, or 10 for sources that count in decimal."""
    def image_ok(column: str) -> Column:
        return F.col(column).isNull() | F.try_parse_json(column).isNotNull()

    rules = (
        ("unknown operation", in_enum(F.col("operation"), CHANGE_OPERATIONS)),
        ("bad log position", is_lsn(F.col("lsn"), base)),
        ("bad before image", image_ok("before_data")),
        ("bad after image", image_ok("after_data")),
    )
    checked = events.withColumn("reasons", F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in rules])))
    good = (
        checked.where(F.size("reasons") == 0)
        .drop("reasons")
        .withColumn("operation", normalise_enum(F.col("operation")))
        .withColumn("before_data", F.nullif(F.col("before_data"), F.lit("{}")))
        .withColumn("after_data", F.nullif(F.col("after_data"), F.lit("{}")))
        .withColumn("status", F.lit("PENDING"))
        .withColumn("retry_count", F.lit(0))
    )
    return good, checked.where(F.size("reasons") > 0)


def changes_in_order(changes: DataFrame, limit: int = CHANGE_BATCH_ROWS, base: int = 16) -> DataFrame:
    """The next pending events of each migration in log order, as numbers."""
    pending = changes.where(F.col("status") == "PENDING")
    first = newest_n(pending, ["migration_id"], [lsn_rank(F.col("lsn"), base), F.col("event_id")], limit)
    return first.withColumn("lsn_num", lsn_number(F.col("lsn"), base))


def dedupe_changes(events: DataFrame, within: str = "10 minutes") -> DataFrame:
    """A re-delivered event once. A stream remembers keys for the watermark."""
    keys = ["table_name", "lsn", "event_id"]
    if events.isStreaming:
        stamped = events.withColumn("_at", F.col("change_timestamp").cast("timestamp")).withWatermark("_at", within)
        return stamped.dropDuplicatesWithinWatermark(keys).drop("_at")
    return events.dropDuplicates(keys)


# ---- applying --------------------------------------------------------------

def keyed_changes(events: DataFrame, row: T.StructType | str, key: str, base: int = 16) -> DataFrame:
    """Changes as (key, image, deleted, log position). An update that moves a row
    to another key becomes a delete and an insert. Events without a key are left
    out; ``keyless_changes`` lists them."""
    decoded = events.select(
        "event_id",
        "operation",
        lsn_rank(F.col("lsn"), base).alias("_lsn"),
        decode_image(F.col("before_data"), row).alias("_before"),
        decode_image(F.col("after_data"), row).alias("_after"),
    )
    old, new = F.col(f"_before.{key}"), F.col(f"_after.{key}")
    gone = F.struct(F.coalesce(old, new).alias(key), F.lit(True).alias("_deleted"), F.lit(0).alias("_step"))
    moved = F.struct(old.alias(key), F.lit(True).alias("_deleted"), F.lit(0).alias("_step"))
    put = F.struct(new.alias(key), F.lit(False).alias("_deleted"), F.lit(1).alias("_step"))
    steps = (
        F.when(F.col("operation") == "DELETE", F.array(gone))
        .when((F.col("operation") == "UPDATE") & old.isNotNull() & (old != new), F.array(moved, put))
        .otherwise(F.array(put))
    )
    return (
        decoded.select("*", F.inline(steps))
        .where(F.col(key).isNotNull())
        .select("event_id", key, "_deleted", "_step", "_lsn", F.when(~F.col("_deleted"), F.col("_after")).alias("_after"))
    )


def keyless_changes(events: DataFrame, row: T.StructType | str, key: str) -> DataFrame:
    """Events neither image of which names the key they need."""
    return events.where(_needed_key(row, key).isNull())


def _needed_key(row: T.StructType | str, key: str) -> Column:
    before, after = (decode_image(F.col(c), row)[key] for c in ("before_data", "after_data"))
    return F.when(F.upper(F.trim("operation")) == "DELETE", F.coalesce(before, after)).otherwise(after)


def _image_fits(column: str, row: T.StructType | str) -> Column:
    """Whether every field of the image has its column's type: else a field would be
    read as null and take the place of a good value."""
    fields = (T.StructType.fromDDL(row) if isinstance(row, str) else row).fields
    checked = T.StructType([*fields, T.StructField("_unfit", T.StringType())])
    image = F.from_json(column, checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unfit"})
    return F.col(column).isNull() | image["_unfit"].isNull()


def split_changes(events: DataFrame, row: T.StructType | str, key: str, base: int = 16) -> tuple[DataFrame, DataFrame]:
    """Events that can be applied to a target of these rows, and all others with the
    reasons: what ``record_changes`` rejects, images whose fields do not fit, and
    events without the key they need. Together they are all events."""
    fit, rejected = record_changes(events, base)
    rules = (
        ("before image does not fit", _image_fits("before_data", row)),
        ("after image does not fit", _image_fits("after_data", row)),
        ("no key", _needed_key(row, key).isNotNull()),
    )
    checked = fit.withColumn("reasons", F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in rules])))
    bad = checked.where(F.size("reasons") > 0).select(*rejected.columns)
    return checked.where(F.size("reasons") == 0).drop("reasons"), rejected.unionByName(bad)


def collapse_changes(keyed: DataFrame, key: str) -> DataFrame:
    """The last change of each key by (log position, event, step)."""
    values = [f.name for f in keyed.schema["_after"].dataType.fields if f.name != key]
    return latest_per_key(keyed, [key], ["_lsn", "event_id", "_step"]).select(
        key, *[F.col(f"_after.{v}").alias(v) for v in values], "_lsn", F.col("event_id").alias("_event_id"), "_deleted"
    )


def collapse_partial_changes(events: DataFrame, key: str, base: int = 16) -> DataFrame:
    """For sources whose after image holds only the changed fields: the newest
    value of every field per key, as rows (key, field, value). Nothing from before
    the last DELETE of a key counts.

    Each field is a row of its own, so one key's history is reduced by partial
    aggregation and never gathered as a list.
    """
    name = lambda column: F.get_json_object(column, f"$.{key}")
    numbered = events.withColumn("_at", F.struct(lsn_rank(F.col("lsn"), base), F.col("event_id")))
    is_delete = F.col("operation") == "DELETE"
    deleted = (
        numbered.where(is_delete)
        .select(F.coalesce(name("before_data"), name("after_data")).alias(key), "_at")
        .groupBy(key)
        .agg(F.max("_at").alias("_gone"))
    )
    fields = numbered.where(~is_delete).select(
        name("after_data").alias(key), "_at", F.explode(F.from_json("after_data", "map<string,string>")).alias("field", "value")
    )
    alive = fields.join(deleted, key, "left").where(F.col("_gone").isNull() | (F.col("_at") > F.col("_gone")))
    return alive.groupBy(key, "field").agg(F.max_by("value", "_at").alias("value"))


def as_loaded(rows: DataFrame, lsn: str | None = None, base: int = 16) -> DataFrame:
    """Full-load rows with the control columns of a replicated target. ``lsn`` is the
    log position noted before the load began: older events do not touch the rows.
    Without it they lie before any position."""
    return (
        rows.withColumn("_lsn", F.lit(LSN_BEFORE_ALL) if lsn is None else lsn_rank(F.lit(lsn), base))
        .withColumn("_event_id", F.lit(-1).cast("bigint"))
        .withColumn("_deleted", F.lit(False))
    )


def apply_changes(
    spark: SparkSession, root: str, events: DataFrame, row: T.StructType | str, key: str, batch: str, buckets: int | None = None, base: int = 16
) -> int:
    """Apply one batch of events of one table. Replays and late events change nothing:
    a stored row gives way only to a greater (log position, event). ``batch`` names this
    content; the target skips a name it has already committed."""
    collapsed = collapse_changes(keyed_changes(events, row, key, base), key)
    return store.upsert(spark, root, collapsed, [key], batch, guard=("_lsn", "_event_id"), buckets=buckets)


def table_root(root: str, table: str) -> str:
    return f"{root}/table={table}"


def apply_table_changes(
    spark: SparkSession, root: str, events: DataFrame, tables: dict[str, tuple[T.StructType | str, str]], batch: str, base: int = 16
) -> None:
    """Apply events of several tables, given as name → (row, key): each table has a
    target of its own, so equal keys of two tables never meet. Events that cannot be
    applied, and those of tables not named, go to the quarantine of this batch; a
    repeated batch writes the same again."""
    known = F.coalesce(F.col("table_name").isin(*tables), F.lit(False))
    held = events.where(~known).withColumn("reasons", F.array(F.lit("unknown table")))
    for name, (row, key) in tables.items():
        good, bad = split_changes(events.where(F.col("table_name") == name), row, key, base)
        held = held.unionByName(bad)
        apply_changes(spark, table_root(root, name), good, row, key, batch, base=base)
    held.write.mode("overwrite").parquet(f"{root}/quarantine/batch={batch}")


def late_changes(events: DataFrame, held: DataFrame, row: T.StructType | str, key: str, base: int = 16) -> DataFrame:
    """Events at or before what the target already holds for their key: SKIPPED."""
    keyed = keyed_changes(events, row, key, base).select("event_id", key, "_lsn")
    stored = held.select(key, F.struct("_lsn", "_event_id").alias("_held"))
    late = F.struct(F.col("_lsn"), F.col("event_id")) <= F.col("_held")
    return keyed.join(stored, key).where(late).select("event_id").distinct().withColumn("status", F.lit("SKIPPED"))


def replicate(
    spark: SparkSession, root: str, mode: str, load: DataFrame, batches: list[DataFrame], row: T.StructType | str, key: str,
    buckets: int | None = None, base: int = 16, load_lsn: str | None = None,
) -> DataFrame:
    """FULL_LOAD, CDC_ONLY or FULL_LOAD_AND_CDC over given batches. The load may
    overlap the changes: log positions decide."""
    if mode in ("FULL_LOAD", "FULL_LOAD_AND_CDC"):
        store.upsert(spark, root, as_loaded(load, load_lsn, base), [key], "full-load", guard=("_lsn", "_event_id"), buckets=buckets)
    if mode in ("CDC_ONLY", "FULL_LOAD_AND_CDC"):
        for events in batches:
            apply_changes(spark, root, events, row, key, f"changes-{uuid.uuid4().hex[:12]}", buckets, base)
    return store.read_target(spark, root)


def _checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity of a stream's checkpoint: kept over restarts, new when it is made anew."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def start_apply(
    stream: DataFrame, root: str, checkpoint: str, row: T.StructType | str = "", key: str = "",
    on_batch: Callable[[DataFrame, int], None] | None = None, max_errors: int = MAX_CONSECUTIVE_ERRORS, back_off: float = 2.0, once: bool = True,
    base: int = 16, every: str = "1 minute", tables: dict[str, tuple[T.StructType | str, str]] | None = None,
) -> StreamingQuery:
    """Keep a target in step with a stream of changes, or with ``tables`` one target
    for each of them.

    ``foreachBatch`` may deliver a batch again; log positions make that harmless.
    A batch is named by the identity that Spark gave the checkpoint and by its number:
    numbers start over with a new checkpoint, also one at the same path, and its batches
    are new ones. Events that cannot be applied go to ``{root}/quarantine``, in one folder
    per batch of this checkpoint, so a batch delivered again does not repeat them.
    A batch that keeps failing is tried ``max_errors`` times in a row, then the
    query stops and a later start on the same checkpoint resumes. Each batch rewrites
    the buckets it touches, so ``every`` should leave time for a worthwhile batch.
    """

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = f"stream-{_checkpoint_id(spark, checkpoint)}-{batch_id}"
        if tables:
            apply_table_changes(spark, root, batch, tables, name, base)
            return
        good, bad = split_changes(batch, row, key, base)
        apply_changes(spark, root, good, row, key, name, base=base)
        bad.write.mode("overwrite").parquet(f"{root}/quarantine/batch={name}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for attempt in range(1, max_errors + 1):
                try:
                    apply_batch(batch, batch_id)
                    break
                except Exception:
                    if attempt == max_errors:
                        raise
                    time.sleep(back_off)
            if on_batch:
                on_batch(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


# ---- following along -------------------------------------------------------

def mark_changes(changes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Events after a batch: PROCESSED with its time, or FAILED with the error and
    one more try counted. Events without an outcome stay as they are."""
    result = outcomes.select("event_id", "failed", "at", "error")
    joined = changes.join(result, "event_id", "left")
    known, failed = F.col("failed").isNotNull(), F.coalesce("failed", F.lit(False))
    return joined.select(
        "event_id",
        "migration_id",
        F.when(failed, "FAILED").when(known, "PROCESSED").otherwise(F.col("status")).alias("status"),
        (F.col("retry_count") + failed.cast("int")).alias("retry_count"),
        F.when(known & ~failed, F.col("at")).otherwise(F.col("processed_at")).alias("processed_at"),
        F.when(failed, F.col("error")).alias("error_message"),
    )


def replication_lag(changes: DataFrame, base: int = 16) -> DataFrame:
    """Per migration and table: mean and greatest lag, last log position and time."""
    seen = changes.where(F.col("status") == "PROCESSED")
    lag = F.timestamp_diff("SECOND", F.col("change_timestamp"), F.col("processed_at"))
    return seen.groupBy("migration_id", "table_name").agg(
        F.max(lag).alias("max_lag_seconds"),
        F.round(F.sum(lag) / F.count(lag).cast("double"), 6).alias("avg_lag_seconds"),
        F.max_by("lsn", F.struct(lsn_rank(F.col("lsn"), base), F.col("event_id"))).alias("last_lsn"),
        F.max("processed_at").alias("last_sync_at"),
    )


def high_lag_alerts(lags: DataFrame, max_lag: int = MAX_LAG_SECONDS) -> DataFrame:
    return lags.where(F.col("max_lag_seconds") > max_lag).select(
        F.lit("HIGH_REPLICATION_LAG").alias("event_type"), "migration_id", "table_name", "max_lag_seconds", "last_lsn"
    )


def event_rate_windows(changes: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events by operation in tumbling windows; a stream drops what comes later
    than the watermark."""
    at = F.col("change_timestamp")
    if changes.isStreaming:
        changes = changes.withColumn("_at", at.cast("timestamp")).withWatermark("_at", late)
        at = F.col("_at")
    return (
        changes.groupBy(F.window(at, width).alias("w"), "operation")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "operation", "events")
    )


def start_progress_feed(stream: DataFrame, feed: str, checkpoint: str, once: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Running counts per migration: each micro-batch appends the rows that
    changed, ``read_feed`` gives the newest.

    Parts are named by the checkpoint's identity and the batch, so a checkpoint made
    anew writes beside the rows of the one before and takes none of them away.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        part = f"{_checkpoint_id(batch.sparkSession, checkpoint)}-{batch_id}"
        batch.withColumn("feed_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{feed}/part={part}")

    writer = change_counts(stream).writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def read_feed(spark: SparkSession, feed: str) -> DataFrame:
    """The newest counts of each migration. Counts only grow, so what a new checkpoint
    tells while it reads the events again does not take the place of more of them."""
    return latest_per_key(spark.read.parquet(feed).drop("part"), ["migration_id"], ["total_events", "feed_batch"]).drop("feed_batch")


def compact_feed(spark: SparkSession, feed: str, into: str) -> None:
    """The feed with one row per migration, as a feed that can be read and continued."""
    newest = latest_per_key(spark.read.parquet(feed).drop("part"), ["migration_id"], ["total_events", "feed_batch"])
    newest.write.mode("errorifexists").parquet(f"{into}/part=compacted")
