"""Control-table schemas, enumerations and limits."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations of the control tables.
JOB_STATUSES = ("PENDING", "QUEUED", "RUNNING", "PAUSED", "COMPLETED", "FAILED", "CANCELLED")
CHUNK_STATUSES = ("PENDING", "RUNNING", "COMPLETED", "FAILED")
CDC_MODES = ("FULL_LOAD", "CDC_ONLY", "FULL_LOAD_AND_CDC")
CHANGE_OPERATIONS = ("INSERT", "UPDATE", "DELETE")
CHANGE_STATUSES = ("PENDING", "PROCESSED", "FAILED", "SKIPPED")
DRIFT_STATUSES = ("DETECTED", "APPROVED", "REJECTED", "IGNORED", "APPLIED")
RISK_LEVELS = ("SAFE", "MODERATE", "HIGH", "CRITICAL")
NOTIFICATION_EVENTS = (
    "MIGRATION_COMPLETED",
    "MIGRATION_FAILED",
    "SCHEMA_APPROVAL_REQUIRED",
    "WORKER_FAILURE",
    "HIGH_REPLICATION_LAG",
    "SCHEMA_DRIFT_DETECTED",
    "LAMBDA_FAILED",
)

# Limits and defaults.
MAX_RETRIES = 3
MAX_LAG_SECONDS = 300
MAX_CONSECUTIVE_ERRORS = 10
STALL_SECONDS = 15
KEEP_CHECKPOINTS = 5
CHANGE_BATCH_ROWS = 1000
AUDIT_RETENTION_DAYS = 90
CHECKPOINT_RETENTION_DAYS = 30

LSN = T.DecimalType(31, 0)

CHANGE_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType(), False),
        T.StructField("migration_id", T.LongType()),
        T.StructField("operation", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("lsn", T.StringType()),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("before_data", T.StringType()),
        T.StructField("after_data", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("retry_count", T.IntegerType()),
        T.StructField("change_timestamp", T.TimestampNTZType()),
        T.StructField("processed_at", T.TimestampNTZType()),
    ]
)

SNAPSHOT_COLUMN = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("primary_key", T.BooleanType()),
    ]
)

SNAPSHOT_TABLE = T.StructType(
    [
        T.StructField("columns", T.ArrayType(SNAPSHOT_COLUMN)),
        T.StructField("indexes", T.ArrayType(T.StringType())),
    ]
)
