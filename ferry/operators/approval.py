"""Approval rules over drift events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ferry.operators.ordered import latest_per_key
from ferry.schemas import RISK_LEVELS


def risk_rank(risk: Column) -> Column:
    """SAFE 0 … CRITICAL 3; a risk nobody knows ranks 99 and is never approved."""
    rank = F.lit(99)
    for i, name in enumerate(RISK_LEVELS):
        rank = F.when(risk == name, i).otherwise(rank)
    return rank


def needs_approval(drift: DataFrame) -> DataFrame:
    return drift.where(
        (F.col("status") == "DETECTED") & F.col("approval_required") & F.col("risk_level").isin("HIGH", "CRITICAL")
    )


def safe_changes(drift: DataFrame) -> DataFrame:
    return drift.where((F.col("status") == "DETECTED") & ~F.col("approval_required") & (F.col("risk_level") == "SAFE"))


def approval_summary(drift: DataFrame) -> DataFrame:
    """All counts of a migration in one pass, absent ones as 0."""
    status, risk = F.col("status"), F.col("risk_level")
    return drift.groupBy("migration_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if((status == "DETECTED") & F.col("approval_required")).alias("pending_approval"),
        F.count_if(status == "APPROVED").alias("approved"),
        F.count_if(status == "REJECTED").alias("rejected"),
        F.count_if(status == "IGNORED").alias("ignored"),
        F.count_if(status == "APPLIED").alias("auto_applied"),
        *[F.count_if(risk == r).alias(f"risk_{r.lower()}") for r in RISK_LEVELS],
    )


def approval_gate(jobs: DataFrame, drift: DataFrame) -> DataFrame:
    """Each job with whether it must wait, how many events hold it and the state
    after the check. Only a RUNNING job is paused."""
    held = needs_approval(drift).groupBy("migration_id").agg(F.count(F.lit(1)).alias("high_risk_events"))
    waits = F.col("high_risk_events").isNotNull()
    pauses = waits & (F.col("status") == "RUNNING")
    return jobs.select("migration_id", "status").join(held, "migration_id", "left").select(
        "migration_id",
        waits.alias("requires_approval"),
        F.coalesce("high_risk_events", F.lit(0).cast("bigint")).alias("high_risk_events"),
        pauses.alias("paused_now"),
        F.when(pauses, "PAUSED").otherwise(F.col("status")).alias("status_after"),
    )


def resolve_events(drift: DataFrame, decisions: DataFrame) -> DataFrame:
    """Drift events after decisions; the last decision on an event wins. Approving
    and rejecting name who and when, ignoring does not."""
    last = latest_per_key(decisions, ["event_id"], ["decided_at", "decision_id"]).select(
        "event_id", "decision", "decided_by", "decided_at", F.col("reason").alias("_reason")
    )
    named = F.col("decision").isin("APPROVED", "REJECTED")
    return drift.join(last, "event_id", "left").select(
        "event_id",
        "migration_id",
        F.coalesce("decision", "status").alias("status"),
        F.when(named, F.col("decided_by")).alias("approved_by"),
        F.when(named, F.col("decided_at")).alias("approved_at"),
        F.when(F.col("decision") == "REJECTED", F.col("_reason")).alias("rejection_reason"),
    )


def approve_and_resume(jobs: DataFrame, drift: DataFrame, approvals: DataFrame) -> DataFrame:
    """Jobs named by approvals with the events approved; PAUSED becomes RUNNING."""
    known = approvals.select("event_id").distinct().join(drift.select("event_id", "migration_id"), "event_id")
    approved = known.groupBy("migration_id").agg(F.count(F.lit(1)).alias("approved_events"))
    return jobs.select("migration_id", "status").join(approved, "migration_id").select(
        "migration_id",
        "approved_events",
        F.when(F.col("status") == "PAUSED", "RUNNING").otherwise(F.col("status")).alias("status_after"),
    )


def auto_apply_safe(drift: DataFrame, by: str = "system_auto") -> DataFrame:
    """Events after the safe ones were applied without asking."""
    safe = (F.col("status") == "DETECTED") & ~F.col("approval_required") & (F.col("risk_level") == "SAFE")
    return drift.select(
        "event_id",
        "migration_id",
        F.when(safe, "APPLIED").otherwise(F.col("status")).alias("status"),
        F.when(safe, by).alias("approved_by"),
    )


def bulk_approve_by_risk(drift: DataFrame, max_risk: str, by: str) -> DataFrame:
    """DETECTED events up to a risk, as approved."""
    if max_risk not in RISK_LEVELS:
        raise ValueError(f"unknown risk level: {max_risk}")
    limit = RISK_LEVELS.index(max_risk)
    return drift.where((F.col("status") == "DETECTED") & (risk_rank(F.col("risk_level")) <= limit)).select(
        "event_id", "migration_id", "risk_level", F.lit("APPROVED").alias("status"), F.lit(by).alias("approved_by")
    )
