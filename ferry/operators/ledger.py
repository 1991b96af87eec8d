"""Chunk states, checkpoints, retry and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ferry.functions.numbers import progress_percent
from ferry.operators.metrics import change_counts
from ferry.operators.ordered import latest_per_key
from ferry.schemas import JOB_STATUSES, STALL_SECONDS

LEDGER = "migration_id bigint, chunk_id string, table_name string, status string, rows_done bigint, error string, noted_at timestamp_ntz"


def current_ledger(ledger: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Newest state row of each chunk; error texts are whole unless a length is given."""
    now = latest_per_key(ledger, ["migration_id", "chunk_id"], ["noted_at", "status"])
    return now if max_chars is None else now.withColumn("error", F.substring("error", 1, max_chars))


def stalled_chunks(ledger_now: DataFrame, asof: str, limit_seconds: int = STALL_SECONDS) -> DataFrame:
    """Open chunks without news for longer than the limit, marked FAILED."""
    bound = F.lit(asof).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(limit_seconds))
    return (
        ledger_now.where(F.col("status").isin("PENDING", "RUNNING") & (F.col("noted_at") < bound))
        .withColumn("status", F.lit("FAILED"))
        .withColumn("error", F.concat(F.lit("no progress for "), F.lit(str(limit_seconds)), F.lit(" seconds")))
    )


def retry_eligible(df: DataFrame, new_status: str, max_retries: Column | None = None, reset: tuple[str, ...] = ()) -> DataFrame:
    """FAILED rows with tries left, in their state after the retry is taken."""
    allowed = F.col("max_retries") if max_retries is None else max_retries
    out = df.where((F.col("status") == "FAILED") & (F.col("retry_count") < allowed))
    out = out.withColumn("retry_count", F.col("retry_count") + 1).withColumn("status", F.lit(new_status))
    for name in reset:
        out = out.withColumn(name, F.lit(0).cast(df.schema[name].dataType))
    return out


def start_guard(jobs: DataFrame) -> DataFrame:
    blocked = F.col("status").isin("RUNNING", "COMPLETED", "CANCELLED")
    return jobs.withColumn("may_start", ~blocked).withColumn(
        "reason", F.when(blocked, F.concat(F.lit("cannot be started from "), F.col("status")))
    )


def apply_status_updates(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Fold progress messages into the jobs: the newest value of each field that
    was sent wins. COMPLETED forces 100 percent; COMPLETED and FAILED set the end time.
    A status that no job can have is not taken over; the rest of its message is."""
    updates = updates.withColumn("status", F.when(F.col("status").isin(*JOB_STATUSES), F.col("status")))
    when = F.struct("noted_at", "update_id")

    def newest(name: str) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), when)).alias(f"_{name}")

    ended = F.max(F.when(F.col("status").isin("COMPLETED", "FAILED"), F.col("noted_at"))).alias("_ended")
    forced = F.max(F.when(F.col("status") == "COMPLETED", when)).alias("_done_at")
    sent = F.max(F.when(F.col("progress_percent").isNotNull(), when)).alias("_sent_at")
    folded = updates.groupBy("migration_id").agg(
        newest("status"), newest("progress_percent"), newest("rows_migrated"), newest("error"), ended, forced, sent
    )
    full = F.col("_done_at").isNotNull() & (F.col("_sent_at").isNull() | (F.col("_done_at") >= F.col("_sent_at")))
    return jobs.join(folded, "migration_id", "left").select(
        "migration_id",
        F.coalesce("_status", "status").alias("status"),
        F.when(full, F.lit(100.0)).otherwise(F.coalesce("_progress_percent", "progress_percent")).alias("progress_percent"),
        F.coalesce("_rows_migrated", "rows_migrated").alias("rows_migrated"),
        F.coalesce("_error", "error_message").alias("error_message"),
        F.coalesce("_ended", "completed_at").alias("completed_at"),
    )


def checkpoints_of(progress: DataFrame, at: Column) -> DataFrame:
    """Checkpoint rows for finished tables: (migration_id, table_name, rows_copied,
    rows_so_far, total_rows)."""
    return progress.select(
        "migration_id",
        F.concat(F.lit("checkpoint_"), F.col("table_name"), F.lit("_"), F.col("rows_so_far").cast("string")).alias("checkpoint_name"),
        progress_percent(F.col("rows_so_far"), F.col("total_rows")).alias("progress_percent"),
        F.col("rows_so_far").alias("rows_processed"),
        F.to_json(F.struct(F.col("table_name").alias("table"), F.col("rows_copied").alias("rows_migrated"))).alias("metadata"),
        at.alias("created_at"),
    )


def roll_back_state(jobs: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Job states after going back to one checkpoint per job: PENDING, counters
    from the checkpoint, errors, times and log position cleared."""
    chosen = checkpoint.select(
        "migration_id", "checkpoint_id", "checkpoint_name", F.col("progress_percent").alias("_percent"), "rows_processed"
    )
    return jobs.join(chosen, "migration_id").select(
        "migration_id",
        "checkpoint_id",
        "checkpoint_name",
        F.lit("PENDING").alias("status"),
        F.col("_percent").alias("progress_percent"),
        F.col("rows_processed").alias("rows_migrated"),
        F.lit(0).alias("retry_count"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"),
        F.lit(None).cast("string").alias("last_lsn"),
    )


def roll_back_rows(target: DataFrame, kept_chunks: DataFrame) -> DataFrame:
    """Target rows of the chunks finished at or before the checkpoint."""
    return target.join(kept_chunks.select(F.col("chunk_id").alias("_chunk_id")), "_chunk_id", "left_semi")


def resume_point(jobs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """RUNNING state from the newest checkpoint of each job that has one."""
    newest = latest_per_key(checkpoints, ["migration_id"], ["created_at", "checkpoint_id"])
    return jobs.select("migration_id").join(newest, "migration_id").select(
        "migration_id",
        "checkpoint_id",
        "checkpoint_name",
        "progress_percent",
        F.col("rows_processed").alias("rows_migrated"),
        F.lit("RUNNING").alias("status"),
    )


def restart_state(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "migration_id",
        F.lit("PENDING").alias("status"),
        F.lit(0.0).alias("progress_percent"),
        F.lit(0).cast("bigint").alias("rows_migrated"),
        F.lit(None).cast("bigint").alias("total_rows"),
        F.lit(0).alias("retry_count"),
        F.lit(None).cast("string").alias("error_message"),
    )


def drop_restarted_changes(changes: DataFrame, restarted: DataFrame) -> DataFrame:
    return changes.join(restarted.select("migration_id"), "migration_id", "left_anti")


def recovery_options(jobs: DataFrame, checkpoints: DataFrame, changes: DataFrame) -> DataFrame:
    """What can be done with each job, with its state, its newest checkpoint and its
    events by outcome (null for a job without events). The list of all checkpoints is
    ``explore.newest_first(checkpoints)``; here it is counted."""
    newest = latest_per_key(checkpoints, ["migration_id"], ["created_at", "checkpoint_id"]).select(
        "migration_id",
        F.col("checkpoint_id").alias("latest_checkpoint_id"),
        F.col("checkpoint_name").alias("latest_checkpoint_name"),
        F.col("rows_processed").alias("latest_rows_processed"),
        F.col("progress_percent").alias("latest_progress_percent"),
        F.col("created_at").alias("latest_created_at"),
    )
    counted = checkpoints.groupBy("migration_id").agg(F.count(F.lit(1)).alias("checkpoints"))
    joined = (
        jobs.select("migration_id", "status", "progress_percent", "rows_migrated", "error_message")
        .join(newest, "migration_id", "left")
        .join(counted, "migration_id", "left")
        .join(change_counts(changes), "migration_id", "left")
    )
    has = F.col("latest_checkpoint_id").isNotNull()
    return joined.select(
        "migration_id",
        "status",
        "progress_percent",
        "rows_migrated",
        "error_message",
        has.alias("can_rollback"),
        (has & F.col("status").isin("FAILED", "PAUSED")).alias("can_resume"),
        F.lit(True).alias("can_restart"),
        ((F.col("failed_events") == 0) & (F.col("processed_events") > 0)).alias("can_resume_cdc"),
        "latest_checkpoint_id",
        "latest_checkpoint_name",
        "latest_rows_processed",
        "latest_progress_percent",
        "latest_created_at",
        F.coalesce("checkpoints", F.lit(0).cast("bigint")).alias("checkpoints"),
        "total_events",
        "processed_events",
        "failed_events",
    )
