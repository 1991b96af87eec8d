"""Ledger, drift, approval, metrics, exploring and notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferry.inputs import Inputs
from ferry.operators import approval, drift, explore, ledger, metrics, notify, ordered
from ferry.queries.registry import query
from ferry.session import fresh_dir
from ferry.sources import target as store

ASOF = "2024-01-20 00:00:00"
JOBS_ASOF = "2001-08-01 00:00:00"

_LEDGER_NOW = """(select * exclude (rn) from (select *, row_number() over (partition by migration_id, chunk_id order by noted_at desc, status desc) as rn
  from ledger) where rn = 1)"""


def _now(t: Inputs):
    return ledger.current_ledger(t.ledger)


# ---- ledger and order ------------------------------------------------------

@query("chunk_ledger", f"select * from {_LEDGER_NOW}", ("ledger",))
def chunk_ledger(t: Inputs):
    return _now(t)


@query(
    "stalled_chunks",
    f"""select migration_id, chunk_id, table_name, rows_done, noted_at, 'FAILED' as status, 'no progress for 15 seconds' as error
        from {_LEDGER_NOW} where status in ('PENDING', 'RUNNING') and noted_at < timestamp '1999-01-01 00:00:00' - interval 15 second""",
    ("ledger",),
)
def stalled_chunks(t: Inputs):
    return ledger.stalled_chunks(_now(t), "1999-01-01 00:00:00")


@query(
    "retry_eligible",
    """select 'job' as kind, migration_id as id, 'QUEUED' as status, retry_count + 1 as retry_count from jobs where status = 'FAILED' and retry_count < 3
       union all select 'notification', notification_id, 'RETRYING', cast(retry_count + 1 as int) from notifications where status = 'FAILED' and retry_count < 3""",
    ("jobs", "notifications"),
)
def retry_eligible(t: Inputs):
    jobs = ledger.retry_eligible(t.jobs, "QUEUED", reset=("rows_migrated", "progress_percent"))
    notes = ledger.retry_eligible(t.notifications, "RETRYING")
    count = F.col("retry_count").cast("int").alias("retry_count")
    return jobs.select(F.lit("job").alias("kind"), F.col("migration_id").alias("id"), "status", count).unionByName(
        notes.select(F.lit("notification").alias("kind"), F.col("notification_id").alias("id"), "status", count)
    )


@query(
    "start_guard",
    """select migration_id, status not in ('RUNNING', 'COMPLETED', 'CANCELLED') as may_start,
         case when status in ('RUNNING', 'COMPLETED', 'CANCELLED') then 'cannot be started from ' || status end as reason from jobs""",
    ("jobs",),
)
def start_guard(t: Inputs):
    return ledger.start_guard(t.jobs).select("migration_id", "may_start", "reason")


def _last(field: str, test: str = "") -> str:
    return f"arg_max({field}, update_id) filter (where {field} is not null{test})"


@query(
    "apply_status_updates",
    f"""with f as (select migration_id, {_last('status')} as s, {_last('progress_percent')} as p, {_last('rows_migrated')} as r, {_last('error')} as e,
           max(noted_at) filter (where status in ('COMPLETED', 'FAILED')) as ended, max(update_id) filter (where status = 'COMPLETED') as done_at,
           max(update_id) filter (where progress_percent is not null) as sent_at from status_updates group by 1)
       select migration_id, coalesce(s, status) as status,
         case when done_at is not null and (sent_at is null or done_at >= sent_at) then 100.0e0 else coalesce(p, progress_percent) end as progress_percent,
         coalesce(r, rows_migrated) as rows_migrated, coalesce(e, error_message) as error_message, coalesce(ended, completed_at) as completed_at
       from jobs left join f using (migration_id)""",
    ("jobs", "status_updates"),
)
def apply_status_updates(t: Inputs):
    return ledger.apply_status_updates(t.jobs, t.status_updates)


@query(
    "save_checkpoint",
    """select migration_id, 'checkpoint_orders_' || rows_migrated as checkpoint_name,
         case when total_rows > 0 then least(rows_migrated * 100.0e0 / total_rows, 100.0e0) else 100.0e0 end as progress_percent,
         rows_migrated as rows_processed, '{"table":"orders","rows_migrated":' || (rows_migrated // 2) || '}' as metadata,
         timestamp '2024-01-20 00:00:00' as created_at from jobs""",
    ("jobs",),
)
def save_checkpoint(t: Inputs):
    progress = t.jobs.select(
        "migration_id", F.lit("orders").alias("table_name"), F.col("rows_migrated").alias("rows_so_far"),
        F.floor(F.col("rows_migrated") / 2).cast("bigint").alias("rows_copied"), "total_rows",
    )
    return ledger.checkpoints_of(progress, F.lit(ASOF).cast("timestamp_ntz"))


_NEWEST_CHECKPOINT = """(select * exclude (rn) from (select *, row_number() over (partition by migration_id order by created_at desc, checkpoint_id desc) as rn
  from checkpoints) where rn = 1)"""


@query("latest_per_key", f"select * from {_NEWEST_CHECKPOINT}", ("checkpoints",))
def latest_per_key(t: Inputs):
    return ordered.latest_per_key(t.checkpoints, ["migration_id"], ["created_at", "checkpoint_id"])


@query(
    "keep_latest_n",
    """select checkpoint_id, migration_id, rn <= 5 as kept from (select *, row_number() over (partition by migration_id
         order by created_at desc, checkpoint_id desc) as rn from checkpoints)""",
    ("checkpoints",),
)
def keep_latest_n(t: Inputs):
    order = [F.col("created_at").desc(), F.col("checkpoint_id").desc()]
    names = ["checkpoint_id", "migration_id"]
    kept = ordered.newest_n(t.checkpoints, ["migration_id"], order, 5).select(*names, F.lit(True).alias("kept"))
    gone = ordered.older_than_newest_n(t.checkpoints, ["migration_id"], order, 5, "checkpoint_id")
    return kept.unionByName(gone.select(*names, F.lit(False).alias("kept")))


@query(
    "cumulative_progress",
    f"""with c as (select migration_id, chunk_id, cast(rows_done as bigint) as rows_done from {_LEDGER_NOW}),
         n as (select migration_id, sum(rows_done) as total from c group by 1),
         r as (select *, cast(sum(rows_done) over (partition by migration_id order by chunk_id) as bigint) as rows_so_far from c)
       select migration_id, chunk_id, rows_so_far, cast(n.total as bigint) as total_rows,
         case when n.total > 0 then least(rows_so_far * 100.0e0 / n.total, 100.0e0) else 100.0e0 end as percent_so_far from r join n using (migration_id)""",
    ("ledger",),
)
def cumulative_progress(t: Inputs):
    rows = _now(t).select("migration_id", "chunk_id", "rows_done")
    out = ordered.cumulative_progress(rows, "migration_id", ["migration_id", "chunk_id"], "rows_done")
    return out.select("migration_id", "chunk_id", "rows_so_far", "total_rows", "percent_so_far")


_STREAK = """select migration_id, batch_id, outcome, cast(sum(case when outcome = 'ERROR' then 1 else 0 end)
    over (partition by migration_id, island order by batch_id) as bigint) as error_run
  from (select *, sum(case when outcome = 'APPLIED' then 1 else 0 end) over (partition by migration_id order by batch_id) as island from poll_log)"""


@query("consecutive_errors", f"select migration_id, batch_id, outcome, error_run, error_run >= 10 as tripped from ({_STREAK})", ("poll_log",))
def consecutive_errors(t: Inputs):
    out = ordered.consecutive_errors(t.poll_log, "migration_id", ["migration_id", "batch_id"], "outcome", 10)
    return out.select("migration_id", "batch_id", "outcome", "error_run", "tripped")


@query(
    "cdc_error_limit",
    f"""select migration_id, min(batch_id) filter (where error_run >= 5) as stops_at_batch, max(error_run) as longest_run,
          cast(2 * count(*) filter (where outcome = 'ERROR') as bigint) as backoff_seconds from ({_STREAK}) group by 1""",
    ("poll_log",),
)
def cdc_error_limit(t: Inputs):
    runs = ordered.consecutive_errors(t.poll_log, "migration_id", ["migration_id", "batch_id"], "outcome", 5)
    return runs.groupBy("migration_id").agg(
        F.min(F.when(F.col("tripped"), F.col("batch_id"))).alias("stops_at_batch"),
        F.max("error_run").alias("longest_run"),
        (F.count_if(F.col("outcome") == "ERROR") * 2).alias("backoff_seconds"),
    )


@query(
    "recent_by_severity",
    """select severity, audit_id, event_type, occurred_at, row_rank from (select *, row_number() over (partition by severity
         order by occurred_at desc, audit_id desc) as row_rank from audit where severity in ('ERROR', 'WARNING')) where row_rank <= 10""",
    ("audit",),
)
def recent_by_severity(t: Inputs):
    return metrics.recent_by_severity(t.audit).select("severity", "audit_id", "event_type", "occurred_at", F.col("row_rank").cast("bigint").alias("row_rank"))


@query(
    "rollback_to_checkpoint",
    f"""select j.migration_id, c.checkpoint_id, c.checkpoint_name, 'PENDING' as status, c.progress_percent, c.rows_processed as rows_migrated,
          0 as retry_count, cast(null as varchar) as error_message, cast(null as timestamp) as completed_at, cast(null as varchar) as last_lsn
        from jobs j join {_NEWEST_CHECKPOINT} c using (migration_id)""",
    ("jobs", "checkpoints"),
)
def rollback_to_checkpoint(t: Inputs):
    newest = ordered.latest_per_key(t.checkpoints, ["migration_id"], ["created_at", "checkpoint_id"])
    return ledger.roll_back_state(t.jobs, newest)


@query("rollback_target_rows", "select * from target_orders", ("target_orders",))
def rollback_target_rows(t: Inputs):
    """Load, apply a batch, then go back to the version before it."""
    root = fresh_dir(t.spark, "target")
    before = store.upsert(t.spark, root, t.target_orders, ["o_orderkey"], "load")
    store.upsert(t.spark, root, t.source_orders, ["o_orderkey"], "batch-1")
    store.roll_back(t.spark, root, before, "undo-batch-1")
    return store.read_target(t.spark, root)


@query(
    "resume_point",
    f"""select migration_id, checkpoint_id, checkpoint_name, c.progress_percent, rows_processed as rows_migrated, 'RUNNING' as status,
          coalesce(p.n, 0) as remaining_chunks
        from jobs join {_NEWEST_CHECKPOINT} c using (migration_id)
        left join (select migration_id, count(*) as n from {_LEDGER_NOW} where status <> 'COMPLETED' group by 1) p using (migration_id)""",
    ("jobs", "checkpoints", "ledger"),
)
def resume_point(t: Inputs):
    left = _now(t).where("status <> 'COMPLETED'").groupBy("migration_id").agg(F.count(F.lit(1)).alias("remaining_chunks"))
    return ledger.resume_point(t.jobs, t.checkpoints).join(left, "migration_id", "left").na.fill(0, ["remaining_chunks"])


@query(
    "restart_state",
    """select migration_id, 'PENDING' as status, 0.0e0 as progress_percent, cast(0 as bigint) as rows_migrated, cast(null as bigint) as total_rows,
         0 as retry_count, cast(null as varchar) as error_message,
         (select count(*) from change_events where migration_id not in (select migration_id from jobs where status = 'FAILED')) as changes_kept
       from jobs where status = 'FAILED'""",
    ("jobs", "change_events"),
)
def restart_state(t: Inputs):
    failed = t.jobs.where("status = 'FAILED'")
    kept = ledger.drop_restarted_changes(t.change_events, failed).agg(F.count(F.lit(1)).alias("n")).first()[0]
    return ledger.restart_state(failed).withColumn("changes_kept", F.lit(kept).cast("bigint"))


@query(
    "recovery_options",
    f"""with n as (select migration_id, count(*) as checkpoints from checkpoints group by 1),
         e as (select migration_id, count(*) as t, count(*) filter (where status = 'FAILED') as f, count(*) filter (where status = 'PROCESSED') as p
           from change_events group by 1)
       select j.migration_id, j.status, j.progress_percent, j.rows_migrated, j.error_message, c.checkpoint_id is not null as can_rollback,
         c.checkpoint_id is not null and j.status in ('FAILED', 'PAUSED') as can_resume, true as can_restart, e.f = 0 and e.p > 0 as can_resume_cdc,
         c.checkpoint_id as latest_checkpoint_id, c.checkpoint_name as latest_checkpoint_name, c.rows_processed as latest_rows_processed,
         c.progress_percent as latest_progress_percent, c.created_at as latest_created_at,
         coalesce(n.checkpoints, 0) as checkpoints, e.t as total_events, e.p as processed_events, e.f as failed_events
       from jobs j left join {_NEWEST_CHECKPOINT} c using (migration_id) left join n using (migration_id) left join e using (migration_id)""",
    ("jobs", "checkpoints", "change_events"),
)
def recovery_options(t: Inputs):
    return ledger.recovery_options(t.jobs, t.checkpoints, t.change_events)


# ---- drift -----------------------------------------------------------------

_TYPE = """case when column_type = 'varchar' and max_length is not null then 'VARCHAR(' || max_length || ')'
  when column_type = 'decimal' and num_precision is not null then 'DECIMAL(' || num_precision || ',' || coalesce(num_scale, 0) || ')'
  else upper(column_type) end"""
_BEFORE_AFTER = ("columns_before", "columns_after")
_INDEXED = (*_BEFORE_AFTER, "indexes_before", "indexes_after")
_COMMON = "(select distinct migration_id, table_name from columns_before intersect select distinct migration_id, table_name from columns_after)"


def _typed(t: Inputs):
    return drift.typed(t.columns_before), drift.typed(t.columns_after)


@query(
    "capture_schema_snapshot",
    f"""with c as (select migration_id, table_name, string_agg('{{"name":"' || column_name || '","type":"' || {_TYPE} || '","nullable":' || nullable
           || ',"primary_key":' || primary_key || '}}', ',' order by ordinal) as cols from columns_after group by 1, 2),
         i as (select migration_id, table_name, string_agg('"' || index_name || '"', ',' order by index_name) as idx from indexes_after group by 1, 2)
       select migration_id, 'snapshot_source_20240120_000000' as snapshot_name, table_name,
         '{{"columns":[' || cols || '],"indexes":[' || coalesce(idx, '') || ']}}' as definition from c left join i using (migration_id, table_name)""",
    ("columns_after", "indexes_after"),
)
def capture_schema_snapshot(t: Inputs):
    return drift.snapshot_documents(t.columns_after, t.indexes_after, "SOURCE", ASOF)


_TABLE_DRIFT = """select migration_id, table_name, case when place = 'new' then 'CREATE_TABLE' else 'DROP_TABLE' end as change_type,
    case when place = 'new' then 'MODERATE' else 'CRITICAL' end as risk_level, cast(null as varchar) as object_name, true as approval_required,
    '{"action":"' || case when place = 'new' then 'table_added' else 'table_dropped' end || '","table":"' || table_name || '"}' as change_details
  from (select migration_id, table_name, case when b.k is null then 'new' when a.k is null then 'removed' else 'common' end as place
    from (select distinct migration_id, table_name, 1 as k from columns_before) b
    full join (select distinct migration_id, table_name, 1 as k from columns_after) a using (migration_id, table_name)) where place <> 'common'"""
_COLUMN_DIFF = f"""select migration_id, table_name, column_name, b.t as before_type, a.t as after_type,
    case when b.t is null then 'ADDED' when a.t is null then 'DROPPED' when b.t <> a.t then 'ALTERED' else 'SAME' end as column_status
  from (select migration_id, table_name, column_name, {_TYPE} as t from columns_before) b
  full join (select migration_id, table_name, column_name, {_TYPE} as t from columns_after) a using (migration_id, table_name, column_name)"""
_COLUMN_DRIFT = f"""select migration_id, table_name,
    case column_status when 'ADDED' then 'ADD_COLUMN' when 'DROPPED' then 'DROP_COLUMN' else 'ALTER_TABLE' end as change_type,
    case column_status when 'ADDED' then 'MODERATE' else 'HIGH' end as risk_level, column_name as object_name, column_status <> 'ADDED' as approval_required,
    '{{"action":"column_' || lower(column_status) || '","table":"' || table_name || '","column":"' || column_name || '"'
      || case when column_status = 'ALTERED' then ',"before_type":"' || before_type || '","after_type":"' || after_type || '"' else '' end || '}}' as change_details
  from ({_COLUMN_DIFF}) where column_status <> 'SAME' and (migration_id, table_name) in (select (migration_id, table_name) from {_COMMON})"""
_INDEX_DRIFT = f"""select migration_id, table_name, case when place = 'new' then 'CREATE_INDEX' else 'DROP_INDEX' end as change_type,
    case when place = 'new' then 'SAFE' else 'MODERATE' end as risk_level, index_name as object_name, place <> 'new' as approval_required,
    '{{"action":"' || case when place = 'new' then 'index_added' else 'index_dropped' end || '","table":"' || table_name || '","index":"' || index_name || '"}}' as change_details
  from (select migration_id, table_name, index_name, case when b.k is null then 'new' when a.k is null then 'removed' else 'common' end as place
    from (select *, 1 as k from indexes_before) b full join (select *, 1 as k from indexes_after) a using (migration_id, table_name, index_name))
  where place <> 'common' and (migration_id, table_name) in (select (migration_id, table_name) from {_COMMON})"""


@query("detect_table_drift", _TABLE_DRIFT, _BEFORE_AFTER)
def detect_table_drift(t: Inputs):
    return drift.table_drift(t.columns_before, t.columns_after)


@query("diff_columns", _COLUMN_DIFF, _BEFORE_AFTER)
def diff_columns(t: Inputs):
    return drift.diff_columns(*_typed(t))


@query("detect_column_drift", _COLUMN_DRIFT, _BEFORE_AFTER)
def detect_column_drift(t: Inputs):
    return drift.column_drift(*_typed(t))


@query("detect_index_drift", _INDEX_DRIFT, _INDEXED)
def detect_index_drift(t: Inputs):
    return drift.index_drift(t.indexes_before, t.indexes_after, t.columns_before, t.columns_after)


@query("union_drift_events", f"{_TABLE_DRIFT} union all {_COLUMN_DRIFT} union all {_INDEX_DRIFT}", _INDEXED)
def union_drift_events(t: Inputs):
    return drift.drift_between(*_typed(t), t.indexes_before, t.indexes_after)


@query(
    "table_set_diff",
    """select o_orderkey, case when d.k is null then 'new' when s.k is null then 'removed' else 'common' end as place
       from (select o_orderkey, 1 as k from source_orders) s full join (select o_orderkey, 1 as k from target_orders) d using (o_orderkey)""",
    ("source_orders", "target_orders"),
)
def table_set_diff(t: Inputs):
    return drift.set_diff(t.source_orders, t.target_orders, ["o_orderkey"])


def _named(kind: str, test: str) -> str:
    return f"coalesce(string_agg(name, ',' order by name) filter (where kind = '{kind}' and {test}), '')"


def _facts(side: str, columns: str, indexes: str, fk_filter: str) -> str:
    return (
        f"select '{side}' as side, 'column' as kind, migration_id, table_name, column_name as name,"
        f" column_type || '|' || nullable || '|' || coalesce(cast(max_length as varchar), '') as shape from {columns}"
        f" union all select '{side}', 'index', migration_id, table_name, index_name, '' from {indexes}"
        f" union all select '{side}', 'foreign_key', migration_id, table_name, constraint_name, '' from table_constraints"
        f" where constraint_type = 'FOREIGN KEY' and {fk_filter}"
    )


_LISTS = "new_columns, removed_columns, modified_columns, new_indexes, removed_indexes, new_foreign_keys, removed_foreign_keys".split(", ")


@query(
    "compare_schemas",
    f"""with f as ({_facts('s', 'columns_after', 'indexes_after', 'migration_id % 5 <> 0')} union all {_facts('t', 'columns_before', 'indexes_before', 'migration_id % 7 <> 0')}),
         m as (select migration_id, table_name, kind, name, max(shape) filter (where side = 's') as s, max(shape) filter (where side = 't') as t from f group by 1, 2, 3, 4),
         g as (select migration_id, table_name, count(*) filter (where kind = 'column' and s is not null) as ns, count(*) filter (where kind = 'column' and t is not null) as nt,
           {_named('column', 't is null')} as new_columns, {_named('column', 's is null')} as removed_columns, {_named('column', 's <> t')} as modified_columns,
           {_named('index', 't is null')} as new_indexes, {_named('index', 's is null')} as removed_indexes,
           {_named('foreign_key', 't is null')} as new_foreign_keys, {_named('foreign_key', 's is null')} as removed_foreign_keys from m group by 1, 2),
         c as (select *, case when nt = 0 then 'NEW' when ns = 0 then 'REMOVED' else 'MODIFIED' end as table_status from g)
       select migration_id, table_name, table_status, {', '.join(f"case when table_status = 'MODIFIED' then {n} else '' end as {n}" for n in _LISTS)}
       from c where table_status <> 'MODIFIED' or {' || '.join(_LISTS)} <> ''""",
    (*_INDEXED, "table_constraints"),
)
def compare_schemas(t: Inputs):
    fks = t.table_constraints.where("constraint_type = 'FOREIGN KEY'")
    return drift.compare_schemas(
        t.columns_after, t.columns_before, t.indexes_after, t.indexes_before,
        fks.where("migration_id % 5 <> 0"), fks.where("migration_id % 7 <> 0"),
    )


@query(
    "foreign_key_map",
    """select c.migration_id, c.table_name, c.constraint_name, k.column_name, r.referenced_table, r.referenced_column
       from table_constraints c join key_columns k using (migration_id, table_name, constraint_name)
         join referenced_columns r using (migration_id, table_name, constraint_name, ordinal)
       where c.constraint_type = 'FOREIGN KEY'""",
    ("table_constraints", "key_columns", "referenced_columns"),
)
def foreign_key_map(t: Inputs):
    return drift.foreign_key_map(t.table_constraints, t.key_columns, t.referenced_columns)


@query(
    "primary_key_columns",
    """select migration_id, table_name, column_name, ordinal, column_name = 'id' as primary_key from columns_after""",
    ("columns_after",),
)
def primary_key_columns(t: Inputs):
    marked = drift.with_primary_keys(t.columns_after, t.table_constraints, t.key_columns)
    return marked.select("migration_id", "table_name", "column_name", "ordinal", "primary_key")


@query(
    "create_table_ddl",
    """with c as (select *, sum(case when primary_key then 1 else 0 end) over (partition by migration_id, table_name) as keys from columns_after)
       select migration_id, table_name, 'CREATE TABLE `' || table_name || '` (' || chr(10) || string_agg('    `' || column_name || '` ' || column_type
           || case when column_type = 'varchar' and max_length is not null then '(' || max_length || ')'
                when column_type = 'decimal' and num_precision is not null then '(' || num_precision || ',' || coalesce(num_scale, 0) || ')' else '' end
           || case when nullable then '' else ' NOT NULL' end || coalesce(' DEFAULT ' || column_default, '')
           || case when auto_increment then ' AUTO_INCREMENT' else '' end || case when primary_key and keys = 1 then ' PRIMARY KEY' else '' end,
           ',' || chr(10) order by ordinal)
         || case when max(keys) > 1 then ',' || chr(10) || '    PRIMARY KEY (' || string_agg('`' || column_name || '`', ', ' order by ordinal) filter (where primary_key) || ')' else '' end
         || chr(10) || ')' as ddl
       from c group by 1, 2""",
    ("columns_after",),
)
def create_table_ddl(t: Inputs):
    return drift.create_table_ddl(t.columns_after)


@query(
    "drift_events",
    "select event_id, migration_id, change_type, risk_level, status, detected_at from drift where status = 'DETECTED' order by detected_at desc, event_id desc",
    ("drift",),
)
def drift_events(t: Inputs):
    found = explore.filter_equals(t.drift, status="DETECTED", risk_level=None)
    return explore.newest_first(found, "detected_at", "event_id").select(
        "event_id", "migration_id", "change_type", "risk_level", "status", "detected_at"
    )


_LAST_DECISION = """(select * exclude (rn) from (select *, row_number() over (partition by event_id order by decided_at desc, decision_id desc) as rn
  from decisions) where rn = 1)"""


@query(
    "resolve_drift_events",
    f"""select event_id, migration_id, coalesce(decision, status) as status, case when decision in ('APPROVED', 'REJECTED') then decided_by end as approved_by,
          case when decision in ('APPROVED', 'REJECTED') then decided_at end as approved_at, case when decision = 'REJECTED' then reason end as rejection_reason
        from drift left join {_LAST_DECISION} using (event_id)""",
    ("drift", "decisions"),
)
def resolve_drift_events(t: Inputs):
    return approval.resolve_events(t.drift, t.decisions)


_HELD = "status = 'DETECTED' and approval_required and risk_level in ('HIGH', 'CRITICAL')"


@query(
    "filter_risk_status",
    f"""select event_id, risk_level, 'held' as what from drift where {_HELD}
        union all select event_id, risk_level, 'safe' from drift where status = 'DETECTED' and not approval_required and risk_level = 'SAFE'""",
    ("drift",),
)
def filter_risk_status(t: Inputs):
    held = approval.needs_approval(t.drift).select("event_id", "risk_level", F.lit("held").alias("what"))
    return held.unionByName(approval.safe_changes(t.drift).select("event_id", "risk_level", F.lit("safe").alias("what")))


@query(
    "approval_gate",
    f"""with h as (select migration_id, count(*) as n from drift where {_HELD} group by 1)
        select migration_id, n is not null as requires_approval, coalesce(n, 0) as high_risk_events, n is not null and status = 'RUNNING' as paused_now,
          case when n is not null and status = 'RUNNING' then 'PAUSED' else status end as status_after from jobs left join h using (migration_id)""",
    ("jobs", "drift"),
)
def approval_gate(t: Inputs):
    return approval.approval_gate(t.jobs, t.drift)


@query(
    "approve_and_resume",
    """with a as (select d.migration_id, count(*) as n from (select distinct event_id from decisions where decision = 'APPROVED') x
         join drift d using (event_id) group by 1)
       select migration_id, n as approved_events, case when status = 'PAUSED' then 'RUNNING' else status end as status_after from jobs join a using (migration_id)""",
    ("jobs", "drift", "decisions"),
)
def approve_and_resume(t: Inputs):
    return approval.approve_and_resume(t.jobs, t.drift, t.decisions.where("decision = 'APPROVED'"))


@query(
    "auto_apply_safe",
    """select event_id, migration_id, case when status = 'DETECTED' and not approval_required and risk_level = 'SAFE' then 'APPLIED' else status end as status,
         case when status = 'DETECTED' and not approval_required and risk_level = 'SAFE' then 'system_auto' end as approved_by from drift""",
    ("drift",),
)
def auto_apply_safe(t: Inputs):
    return approval.auto_apply_safe(t.drift)


@query(
    "bulk_approve_by_risk",
    """select event_id, migration_id, risk_level, 'APPROVED' as status, 'lead' as approved_by from drift
       where status = 'DETECTED' and risk_level in ('SAFE', 'MODERATE')""",
    ("drift",),
)
def bulk_approve_by_risk(t: Inputs):
    return approval.bulk_approve_by_risk(t.drift, "MODERATE", "lead")


@query(
    "approval_summary",
    "select migration_id, count(*) as total_events, count(*) filter (where status = 'DETECTED' and approval_required) as pending_approval, "
    + ", ".join(
        f"count(*) filter (where status = '{s}') as {n}"
        for s, n in (("APPROVED", "approved"), ("REJECTED", "rejected"), ("IGNORED", "ignored"), ("APPLIED", "auto_applied"))
    )
    + ", "
    + ", ".join(f"count(*) filter (where risk_level = '{r}') as risk_{r.lower()}" for r in ("SAFE", "MODERATE", "HIGH", "CRITICAL"))
    + " from drift group by 1",
    ("drift",),
)
def approval_summary(t: Inputs):
    return approval.approval_summary(t.drift)


# ---- metrics ---------------------------------------------------------------

@query(
    "cdc_event_statistics",
    """select migration_id, count(*) as total_events, count(*) filter (where status = 'PENDING') as pending_events,
         count(*) filter (where status = 'PROCESSED') as processed_events, count(*) filter (where status = 'FAILED') as failed_events
       from change_events group by 1""",
    ("change_events",),
)
def cdc_event_statistics(t: Inputs):
    return metrics.change_counts(t.change_events)


@query(
    "system_health",
    """select (select count(*) from jobs) as total_jobs, (select count(*) from jobs where status = 'RUNNING') as running_jobs,
         (select count(*) from jobs where status = 'FAILED') as failed_jobs, (select count(*) from jobs where status = 'COMPLETED') as completed_jobs,
         (select count(*) from customer) as total_connections, (select count(*) from customer where c_acctbal > 0) as active_connections,
         (select count(*) from supplier) as total_configs""",
    ("jobs",),
)
def system_health(t: Inputs):
    connections = t.customer.select((F.col("c_acctbal") > 0).alias("connected"))
    return metrics.system_health(t.jobs, connections, t.supplier)


@query(
    "chunk_progress",
    f"""select migration_id, count(*) as chunks_total, count(*) filter (where status = 'COMPLETED') as chunks_completed,
          count(*) filter (where status = 'FAILED') as chunks_failed, cast(coalesce(sum(rows_done) filter (where status = 'COMPLETED'), 0) as bigint) as rows_migrated,
          count(*) filter (where status = 'COMPLETED') * 100.0e0 / count(*) as progress_percent, count(*) filter (where status = 'COMPLETED') = count(*) as done
        from {_LEDGER_NOW} group by 1""",
    ("ledger",),
)
def chunk_progress(t: Inputs):
    return metrics.chunk_progress(_now(t))


@query(
    "daily_throughput",
    """select cast(d as date) as day, (select count(*) from jobs where cast(created_at as date) = cast(d as date)) as started,
         (select count(*) from jobs where cast(completed_at as date) = cast(d as date) and status = 'COMPLETED') as completed,
         (select count(*) from jobs where cast(completed_at as date) = cast(d as date) and status = 'FAILED') as failed
       from range(timestamp '2001-07-26', timestamp '2001-08-02', interval 1 day) r(d)""",
    ("jobs",),
)
def daily_throughput(t: Inputs):
    return metrics.daily_throughput(t.jobs, JOBS_ASOF)


@query(
    "health_score",
    """with c as (select count(*) as total, count(*) filter (where status = 'COMPLETED') as completed, count(*) filter (where status = 'RUNNING') as running,
         count(*) filter (where status = 'FAILED') as failed from jobs)
       select *, cast(floor(completed * 40.0e0 / greatest(total, 1) + case when running > 0 then 20 else 0 end + case when failed = 0 then 20 else 0 end + 20 + 0.5e0) as bigint) as health_score,
         cast(floor(completed * 100.0e0 / total + 0.5e0) as bigint) as success_rate from c""",
    ("jobs",),
)
def health_score(t: Inputs):
    return metrics.health_score(t.jobs)


@query("status_distribution", "select status, count(*) as jobs from jobs where status in ('COMPLETED', 'RUNNING', 'PENDING', 'FAILED') group by 1", ("jobs",))
def status_distribution(t: Inputs):
    return metrics.status_distribution(t.jobs)


@query(
    "cdc_operation_stats",
    """with c as (select migration_id, count(*) as total_events, count(*) filter (where operation = 'INSERT') as inserts,
           count(*) filter (where operation = 'UPDATE') as updates, count(*) filter (where operation = 'DELETE') as deletes,
           cast(floor(epoch(max(change_timestamp) - min(change_timestamp))) as bigint) as span_seconds,
           sum(cast(epoch(processed_at - change_timestamp) as bigint)) as lag_sum from change_events group by 1)
       select migration_id, total_events, inserts, updates, deletes, span_seconds, round(total_events / nullif(cast(span_seconds as double), 0), 6) as events_per_second,
         round(lag_sum / cast(total_events as double), 6) as avg_lag_seconds from c""",
    ("change_events",),
)
def cdc_operation_stats(t: Inputs):
    return metrics.change_operation_stats(t.change_events)


@query(
    "migration_rate_eta",
    """with a as (select migration_id, count(*) filter (where severity = 'ERROR') as e, count(*) filter (where severity = 'WARNING') as w from audit group by 1),
         c as (select migration_id, count(*) as n, max(created_at) as at from checkpoints group by 1),
         r as (select *, greatest(total_rows - rows_migrated, 0) as rows_left,
           rows_migrated / nullif(cast(greatest(floor(epoch(coalesce(completed_at, timestamp '2001-08-01') - created_at)), 0) as double), 0) as rate from jobs)
       select migration_id, rows_left as rows_remaining, round(coalesce(rate, 0), 6) as rows_per_second,
         cast(case when rate > 0 then ceil(rows_left / rate) end as bigint) as seconds_remaining, coalesce(e, 0) as errors_count, coalesce(w, 0) as warnings_count,
         coalesce(n, 0) as checkpoints_created, c.at as last_checkpoint_at
       from r left join a using (migration_id) left join c using (migration_id)""",
    ("jobs", "audit", "checkpoints"),
)
def migration_rate_eta(t: Inputs):
    return metrics.migration_rate_eta(t.jobs, t.audit, t.checkpoints, JOBS_ASOF)


_NEWEST_RUN = "(select * exclude (rn) from (select *, row_number() over (partition by migration_id order by run_id desc) as rn from runs) where rn = 1)"


@query(
    "migration_metrics",
    f"""with l as (select migration_id, count(*) as n from audit group by 1),
         r as (select migration_id, string_agg(cast(audit_id as varchar), ',' order by rn) as ids from (select *, row_number() over (partition by migration_id
           order by occurred_at desc, audit_id desc) as rn from audit) where rn <= 10 group by 1),
         e as (select migration_id, count(*) as total, count(*) filter (where status = 'PROCESSED') as p, count(*) filter (where status = 'FAILED') as f from change_events group by 1)
       select j.migration_id, j.status, j.progress_percent, j.rows_migrated, j.total_rows, j.retry_count, coalesce(l.n, 0) as audit_log_count, r.ids as recent_audits,
         coalesce(e.total, 0) as total_events, coalesce(e.p, 0) as processed_events, coalesce(e.f, 0) as failed_events, coalesce(e.total - e.p - e.f, 0) as open_events,
         u.run_id, u.run_status, u.chunks_created, u.chunks_completed, u.chunks_failed
       from jobs j left join l using (migration_id) left join r using (migration_id) left join e using (migration_id) left join {_NEWEST_RUN} u using (migration_id)""",
    ("jobs", "audit", "change_events", "runs"),
)
def migration_metrics(t: Inputs):
    return metrics.migration_metrics(t.jobs, t.audit, t.change_events, t.runs)


@query(
    "job_with_latest_run",
    f"""select migration_id, job_name, status, run_id, run_status, chunks_created, chunks_completed, coalesce(nullif(chunks_total, 0), chunks_created) as chunks_total,
          coalesce(nullif(error_message, ''), run_error) as error_message from jobs left join {_NEWEST_RUN} using (migration_id)""",
    ("jobs", "runs"),
)
def job_with_latest_run(t: Inputs):
    return metrics.job_with_latest_run(t.jobs, t.runs)


# ---- exploring -------------------------------------------------------------

@query(
    "filter_equals",
    "select audit_id, event_type, event_category, severity, migration_id from audit where severity = 'ERROR' and event_category = 'CDC'",
    ("audit",),
)
def filter_equals(t: Inputs):
    found = explore.filter_equals(t.audit, event_type="", event_category="CDC", migration_id=None, severity="ERROR")
    return found.select("audit_id", "event_type", "event_category", "severity", "migration_id")


@query(
    "search_any_column",
    "select * from orders where contains(lower(o_orderpriority), 'urgent') or contains(lower(o_orderstatus), 'urgent') or contains(cast(o_orderkey as varchar), 'urgent')",
)
def search_any_column(t: Inputs):
    return explore.search_any_column(t.orders, "Urgent", ["o_orderpriority", "o_orderstatus", "o_orderkey"])


@query("user_tables_only", "select * from catalog_tables where table_schema = 'public' and table_type = 'BASE TABLE'", ("catalog_tables",))
def user_tables_only(t: Inputs):
    return explore.user_tables_only(t.catalog_tables, "POSTGRESQL")


@query(
    "filter_retention",
    """select audit_id as id, 'audit' as kind from audit where occurred_at >= timestamp '2024-04-05' - interval 90 day
       union all select checkpoint_id, 'checkpoint' from checkpoints where created_at >= timestamp '2024-02-15' - interval 30 day""",
    ("audit", "checkpoints"),
)
def filter_retention(t: Inputs):
    audits = explore.filter_retention(t.audit, "occurred_at", 90, "2024-04-05 00:00:00")
    saved = explore.filter_retention(t.checkpoints, "created_at", 30, "2024-02-15 00:00:00")
    return audits.select(F.col("audit_id").alias("id"), F.lit("audit").alias("kind")).unionByName(
        saved.select(F.col("checkpoint_id").alias("id"), F.lit("checkpoint").alias("kind"))
    )


@query("order_newest", "select migration_id, job_name, status, created_at from jobs order by created_at desc, migration_id desc", ("jobs",))
def order_newest(t: Inputs):
    return explore.newest_first(t.jobs.select("migration_id", "job_name", "status", "created_at"), "created_at", "migration_id")


@query("page_rows", "select audit_id, severity, occurred_at from audit order by occurred_at desc, audit_id desc limit 100 offset 200", ("audit",))
def page_rows(t: Inputs):
    order = [F.col("occurred_at").desc(), F.col("audit_id").desc()]
    return explore.page_rows(t.audit.select("audit_id", "severity", "occurred_at"), order, 100, 200)


@query("top_recent", "select migration_id, status, created_at from jobs order by created_at desc, migration_id desc limit 5", ("jobs",))
def top_recent(t: Inputs):
    return explore.newest_first(t.jobs, "created_at", "migration_id").limit(5).select("migration_id", "status", "created_at")


@query("sort_nulls_last", "select migration_id, completed_at, error_message from jobs order by completed_at desc nulls last, migration_id", ("jobs",))
def sort_nulls_last(t: Inputs):
    rows = t.jobs.select("migration_id", "completed_at", "error_message")
    return explore.sort_nulls_last(rows, "completed_at", descending=True, tie="migration_id")


# ---- notifications ---------------------------------------------------------

@query(
    "notification_history",
    "select n.notification_id, n.config_id, s.user_id, n.event_type, n.status, n.created_at from notifications n join subscriptions s using (config_id)",
    ("notifications", "subscriptions"),
)
def notification_history(t: Inputs):
    return notify.notification_history(t.notifications, t.subscriptions).select(
        "notification_id", "config_id", "user_id", "event_type", "status", "created_at"
    )


@query(
    "fan_out_daily_digest",
    """with a as (select event_type, cast(created_at as date) as day, count(*) as events from notifications group by 1, 2)
       select s.config_id, s.notification_type, a.event_type, a.day, a.events, 'PENDING' as status
       from a join subscriptions s on s.enabled and (s.subscribed_events = '[]' or contains(s.subscribed_events, '"' || a.event_type || '"'))""",
    ("notifications", "subscriptions"),
)
def fan_out_daily_digest(t: Inputs):
    """A daily digest per event type goes to everyone subscribed to it."""
    digest = t.notifications.groupBy("event_type", F.col("created_at").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("events"))
    return notify.fan_out(digest, t.subscriptions)
