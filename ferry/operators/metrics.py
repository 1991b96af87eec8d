"""Progress, health and throughput figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ferry.operators.ordered import latest_per_key, newest_n


def change_counts(changes: DataFrame) -> DataFrame:
    """Events per migration by status in one pass. SKIPPED counts in the total only."""
    status = F.col("status")
    return changes.groupBy("migration_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(status == "PENDING").alias("pending_events"),
        F.count_if(status == "PROCESSED").alias("processed_events"),
        F.count_if(status == "FAILED").alias("failed_events"),
    )


def system_health(jobs: DataFrame, connections: DataFrame, configs: DataFrame) -> DataFrame:
    """One row of counts over three tables: each is reduced on its own and the
    three results are added up."""
    names = (
        "total_jobs", "running_jobs", "failed_jobs", "completed_jobs",
        "total_connections", "active_connections", "total_configs",
    )

    def counts(df: DataFrame, **found) -> DataFrame:
        return df.agg(*[found[n].alias(n) if n in found else F.lit(0).cast("bigint").alias(n) for n in names])

    one, status = F.count(F.lit(1)), F.col("status")
    parts = (
        counts(
            jobs,
            total_jobs=one,
            running_jobs=F.count_if(status == "RUNNING"),
            failed_jobs=F.count_if(status == "FAILED"),
            completed_jobs=F.count_if(status == "COMPLETED"),
        )
        .unionByName(counts(connections, total_connections=one, active_connections=F.count_if(F.col("connected"))))
        .unionByName(counts(configs, total_configs=one))
    )
    return parts.agg(*[F.sum(n).alias(n) for n in names])


def chunk_progress(ledger_now: DataFrame) -> DataFrame:
    status = F.col("status")
    counted = ledger_now.groupBy("migration_id").agg(
        F.count(F.lit(1)).alias("chunks_total"),
        F.count_if(status == "COMPLETED").alias("chunks_completed"),
        F.count_if(status == "FAILED").alias("chunks_failed"),
        F.coalesce(F.sum(F.when(status == "COMPLETED", F.col("rows_done"))), F.lit(0)).alias("rows_migrated"),
    )
    return counted.withColumn(
        "progress_percent", F.col("chunks_completed") * 100.0 / F.col("chunks_total").cast("double")
    ).withColumn("done", F.col("chunks_completed") == F.col("chunks_total"))


def daily_throughput(jobs: DataFrame, asof: str, days: int = 7) -> DataFrame:
    """Started, completed and failed jobs on each of the last days, zero days kept.

    Each job is read once and turned into the (day, what) facts it adds; only
    the days asked for take part in the aggregate.
    """
    last = F.lit(asof).cast("date")
    first = F.date_sub(last, days - 1)
    facts = jobs.select(
        F.inline(
            F.array(
                F.struct(F.col("created_at").cast("date").alias("day"), F.lit("started").alias("what")),
                F.struct(
                    F.col("completed_at").cast("date").alias("day"),
                    F.when(F.col("status") == "COMPLETED", "completed").when(F.col("status") == "FAILED", "failed").alias("what"),
                ),
            )
        )
    ).where(F.col("day").between(first, last) & F.col("what").isNotNull())
    counted = facts.groupBy("day").agg(
        *[F.count_if(F.col("what") == w).alias(w) for w in ("started", "completed", "failed")]
    )
    spine = jobs.sparkSession.range(days).select(F.date_add(first, F.col("id").cast("int")).alias("day"))
    return spine.join(counted, "day", "left").na.fill(0, ["started", "completed", "failed"])


def health_score(jobs: DataFrame, api_healthy: bool = True) -> DataFrame:
    """0–100: up to 40 for completed jobs, 20 each for running work, no failures
    and a healthy API; and the success rate in percent."""
    status = F.col("status")
    counts = jobs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "COMPLETED").alias("completed"),
        F.count_if(status == "RUNNING").alias("running"),
        F.count_if(status == "FAILED").alias("failed"),
    )
    score = (
        F.col("completed") * 40.0 / F.greatest(F.col("total"), F.lit(1)).cast("double")
        + F.when(F.col("running") > 0, 20).otherwise(0)
        + F.when(F.col("failed") == 0, 20).otherwise(0)
        + F.lit(20 if api_healthy else 0)
    )
    rate = F.when(F.col("total") > 0, F.floor(F.col("completed") * 100.0 / F.col("total").cast("double") + 0.5)).otherwise(0)
    return counts.select(
        "total", "completed", "running", "failed",
        F.floor(score + 0.5).cast("bigint").alias("health_score"),
        rate.cast("bigint").alias("success_rate"),
    )


def status_distribution(jobs: DataFrame, statuses: tuple[str, ...] = ("COMPLETED", "RUNNING", "PENDING", "FAILED")) -> DataFrame:
    return jobs.where(F.col("status").isin(*statuses)).groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


def change_operation_stats(changes: DataFrame) -> DataFrame:
    """Per migration: events by operation, events per second and mean lag."""
    operation = F.col("operation")
    lag = F.timestamp_diff("SECOND", F.col("change_timestamp"), F.col("processed_at"))
    counted = changes.groupBy("migration_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(operation == "INSERT").alias("inserts"),
        F.count_if(operation == "UPDATE").alias("updates"),
        F.count_if(operation == "DELETE").alias("deletes"),
        F.timestamp_diff("SECOND", F.min("change_timestamp"), F.max("change_timestamp")).alias("span_seconds"),
        F.sum(lag).alias("_lag"),
        F.count(lag).alias("_lags"),
    )
    span = F.nullif(F.col("span_seconds").cast("double"), F.lit(0.0))
    return counted.select(
        "migration_id", "total_events", "inserts", "updates", "deletes", "span_seconds",
        F.round(F.col("total_events") / span, 6).alias("events_per_second"),
        F.round(F.col("_lag") / F.nullif(F.col("_lags").cast("double"), F.lit(0.0)), 6).alias("avg_lag_seconds"),
    )


def migration_rate_eta(jobs: DataFrame, audit: DataFrame, checkpoints: DataFrame, asof: str) -> DataFrame:
    """Rows left, mean rows per second, seconds left (null at rate 0), message and
    checkpoint counts of each job."""
    severity = F.col("severity")
    messages = audit.groupBy("migration_id").agg(
        F.count_if(severity == "ERROR").alias("errors_count"), F.count_if(severity == "WARNING").alias("warnings_count")
    )
    saved = checkpoints.groupBy("migration_id").agg(
        F.count(F.lit(1)).alias("checkpoints_created"), F.max("created_at").alias("last_checkpoint_at")
    )
    end = F.coalesce(F.col("completed_at"), F.lit(asof).cast("timestamp_ntz"))
    seconds = F.nullif(F.greatest(F.timestamp_diff("SECOND", F.col("created_at"), end), F.lit(0)).cast("double"), F.lit(0.0))
    left = F.greatest(F.col("total_rows") - F.col("rows_migrated"), F.lit(0))
    rate = F.col("rows_migrated") / seconds
    joined = jobs.join(messages, "migration_id", "left").join(saved, "migration_id", "left")
    return joined.select(
        "migration_id",
        left.alias("rows_remaining"),
        F.round(F.coalesce(rate, F.lit(0.0)), 6).alias("rows_per_second"),
        F.when(rate > 0, F.ceil(left / rate)).cast("bigint").alias("seconds_remaining"),
        F.coalesce("errors_count", F.lit(0)).alias("errors_count"),
        F.coalesce("warnings_count", F.lit(0)).alias("warnings_count"),
        F.coalesce("checkpoints_created", F.lit(0)).alias("checkpoints_created"),
        "last_checkpoint_at",
    )


def migration_metrics(jobs: DataFrame, audit: DataFrame, changes: DataFrame, runs: DataFrame, audit_cap: int | None = None, recent: int = 10) -> DataFrame:
    """Job fields with audit, change and run figures. ``recent_audits`` lists the
    ids of the newest messages, newest first. ``audit_cap`` bounds the message count shown."""
    messages = F.count(F.lit(1))
    logged = audit.groupBy("migration_id").agg((messages if audit_cap is None else F.least(messages, F.lit(audit_cap))).alias("audit_log_count"))
    order = [F.col("occurred_at").desc(), F.col("audit_id").desc()]
    newest = (
        newest_n(audit.select("migration_id", "occurred_at", "audit_id"), ["migration_id"], order, recent)
        .groupBy("migration_id")
        .agg(F.sort_array(F.collect_list(F.struct("row_rank", "audit_id"))).alias("_recent"))
        .select("migration_id", F.array_join(F.transform("_recent", lambda r: r["audit_id"].cast("string")), ",").alias("recent_audits"))
    )
    events = change_counts(changes).select(
        "migration_id", "total_events", "processed_events", "failed_events",
        (F.col("total_events") - F.col("processed_events") - F.col("failed_events")).alias("open_events"),
    )
    run = latest_per_key(runs, ["migration_id"], ["run_id"]).select(
        "migration_id", "run_id", "run_status", "chunks_created", "chunks_completed", "chunks_failed"
    )
    out = jobs.select("migration_id", "status", "progress_percent", "rows_migrated", "total_rows", "retry_count")
    for part in (logged, newest, events, run):
        out = out.join(part, "migration_id", "left")
    return out.na.fill(0, ["audit_log_count", "total_events", "processed_events", "failed_events", "open_events"])


def job_with_latest_run(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Each job with its newest run; a job without runs stays. A chunk total of
    null or 0 falls back to the chunks created, a missing job error to the run's."""
    newest = latest_per_key(runs, ["migration_id"], ["run_id"])
    total = F.coalesce(F.nullif(F.col("chunks_total"), F.lit(0)), F.col("chunks_created"))
    error = F.coalesce(F.nullif(F.col("error_message"), F.lit("")), F.col("run_error"))
    return jobs.join(newest, "migration_id", "left").select(
        "migration_id", "job_name", "status", "run_id", "run_status", "chunks_created", "chunks_completed",
        total.alias("chunks_total"), error.alias("error_message"),
    )


def recent_by_severity(audit: DataFrame, n: int = 10) -> DataFrame:
    order = [F.col("occurred_at").desc(), F.col("audit_id").desc()]
    return newest_n(audit.where(F.col("severity").isin("ERROR", "WARNING")), ["severity"], order, n)


def stale_workers(heartbeats: DataFrame, asof: str, limit_seconds: int) -> DataFrame:
    """Workers without a sign of life for longer than the limit."""
    silent = F.timestamp_diff("SECOND", F.col("last_seen"), F.lit(asof).cast("timestamp_ntz"))
    return (
        heartbeats.groupBy("worker_id")
        .agg(F.max("seen_at").alias("last_seen"))
        .withColumn("silent_seconds", silent)
        .where(F.col("silent_seconds") > limit_seconds)
    )
