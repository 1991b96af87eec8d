"""Control tables derived from the supplier/order tables by fixed rules.

Nothing here reads or makes data of its own: every table is a projection of a
given one, so it grows with it. Rules are written as SQL expressions that Spark
and ANSI SQL read alike, and ``as_sql`` gives the same rule as query text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _pick(number: str, *values: str) -> str:
    """CASE over a small number; the last value is the default."""
    arms = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values[:-1]))
    return f"case {number} {arms} else '{values[-1]}' end"


_JOB_STATUS = _pick(
    "o_orderkey % 7", "PENDING", "QUEUED", "RUNNING", "PAUSED", "COMPLETED", "FAILED", "CANCELLED"
)
_OPERATION = "case event_type when 'signup' then 'INSERT' when 'error' then 'DELETE' else 'UPDATE' end"
_IMAGE = (
    "concat('{\"id\":', cast(user_id as string), ',\"value\":', cast(cast(value as decimal(12,2)) as string), ',',"
    " replace(replace(props, '{', ''), '}', ''), '}')"
)
_NOTICE = (
    "case event_type when 'error' then 'WORKER_FAILURE' when 'purchase' then 'MIGRATION_COMPLETED'"
    " when 'signup' then 'SCHEMA_DRIFT_DETECTED' when 'click' then 'HIGH_REPLICATION_LAG'"
    " else 'MIGRATION_FAILED' end"
)
_LEDGER_TAIL = (
    "o_custkey as migration_id",
    "concat(cast(o_custkey as string), '#orders#', cast(o_orderkey as string)) as chunk_id",
    "'orders' as table_name",
)
_CATALOG_KEY = (
    "o_custkey as migration_id",
    "concat('t_', cast(o_orderkey as string)) as table_name",
)

# name → list of (given table, projected expressions, filter or None); several
# entries are unioned.
RULES: dict[str, list[tuple[str, tuple[str, ...], str | None]]] = {
    "source_orders": [("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), None)],
    "target_orders": [
        (
            "orders",
            (
                "o_orderkey",
                "o_custkey",
                "o_orderstatus",
                "case when o_orderkey % 89 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice",
                "o_orderdate",
                "o_orderpriority",
            ),
            "o_orderkey % 97 <> 0",
        ),
        (
            "orders",
            ("o_orderkey + 10000000000 as o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
            "o_orderkey % 101 = 0",
        ),
    ],
    "jobs": [
        (
            "orders",
            (
                "o_orderkey as migration_id",
                "concat('job_', cast(o_orderkey as string)) as job_name",
                f"{_JOB_STATUS} as status",
                "o_orderdate as created_at",
                "case when o_orderkey % 7 in (4, 5) then o_orderdate + interval 1 day end as completed_at",
                "cast((o_orderkey % 50) * 1000 as bigint) as total_rows",
                "cast(case when o_orderkey % 7 = 4 then (o_orderkey % 50) * 1000 else (o_orderkey % 50) * 500 end as bigint) as rows_migrated",
                "case when o_orderkey % 7 = 4 then 100.0e0 else 50.0e0 end as progress_percent",
                "cast(o_orderkey % 5 as int) as retry_count",
                "3 as max_retries",
                "1000 as chunk_size",
                "case when o_orderkey % 14 = 5 then concat('job error ', cast(o_orderkey as string)) end as error_message",
            ),
            None,
        )
    ],
    "runs": [
        (
            "events",
            (
                "event_id as run_id",
                "user_id as migration_id",
                "case event_id % 4 when 0 then 'pending' when 1 then 'running' when 2 then 'completed' else 'failed' end as run_status",
                "cast(event_id % 20 as int) as chunks_created",
                "cast(event_id % 7 as int) as chunks_completed",
                "cast(event_id % 3 as int) as chunks_failed",
                "case event_id % 5 when 0 then null when 1 then 0 else cast(event_id % 30 as int) end as chunks_total",
                "case when event_id % 4 = 3 then concat('run error ', cast(event_id as string)) end as run_error",
            ),
            None,
        )
    ],
    "change_events": [
        (
            "events",
            (
                "event_id",
                "event_id % 20 as migration_id",
                f"{_OPERATION} as operation",
                "'customer' as table_name",
                "concat(hex(cast(floor(event_id / 256) as bigint)), '/', hex((event_id % 256) * 16777216)) as lsn",
                "concat('tx_', cast(floor(event_id / 4) as bigint)) as transaction_id",
                f"case when event_type = 'error' or event_id % 2 = 1 then concat('{{\"id\":', cast(user_id as string), '}}') end as before_data",
                f"case when event_type <> 'error' then {_IMAGE} end as after_data",
                "case event_id % 10 when 0 then 'FAILED' when 1 then 'PENDING' when 2 then 'SKIPPED' else 'PROCESSED' end as status",
                "cast(event_id % 4 as int) as retry_count",
                "ts as change_timestamp",
                "ts + (event_id % 600) * interval '1' second as processed_at",
            ),
            None,
        )
    ],
    "audit": [
        (
            "events",
            (
                "event_id as audit_id",
                "user_id as migration_id",
                "event_type",
                _pick("event_id % 3", "MIGRATION", "CDC", "SCHEMA") + " as event_category",
                "case event_type when 'error' then 'ERROR' when 'click' then 'WARNING' else 'INFO' end as severity",
                "props as event_description",
                "ts as occurred_at",
            ),
            None,
        )
    ],
    "checkpoints": [
        (
            "events",
            (
                "event_id as checkpoint_id",
                "user_id as migration_id",
                "concat('checkpoint_', event_type, '_', cast(event_id as string)) as checkpoint_name",
                "cast(event_id % 101 as double) as progress_percent",
                "event_id as rows_processed",
                "ts as created_at",
            ),
            None,
        )
    ],
    "subscriptions": [
        (
            "customer",
            (
                "c_custkey as config_id",
                "c_nationkey as user_id",
                _pick("c_custkey % 3", "EMAIL", "SLACK", "WEBHOOK") + " as notification_type",
                "c_custkey % 4 <> 0 as enabled",
                "case when c_custkey % 5 = 0 then '[]'"
                " when c_custkey % 5 = 1 then '[\"WORKER_FAILURE\"]'"
                " when c_custkey % 5 = 2 then '[\"MIGRATION_COMPLETED\",\"MIGRATION_FAILED\"]'"
                " when c_custkey % 5 = 3 then '[\"HIGH_REPLICATION_LAG\"]'"
                " else '[\"SCHEMA_DRIFT_DETECTED\",\"SCHEMA_APPROVAL_REQUIRED\"]' end as subscribed_events",
            ),
            None,
        )
    ],
    "notifications": [
        (
            "events",
            (
                "event_id as notification_id",
                "user_id as config_id",
                "event_id % 20 as migration_id",
                f"{_NOTICE} as event_type",
                _pick("event_id % 4", "PENDING", "SENT", "FAILED", "RETRYING") + " as status",
                "cast(floor(event_id / 4) as bigint) % 5 as retry_count",
                "3 as max_retries",
                "ts as created_at",
            ),
            None,
        )
    ],
    "people": [
        (
            "customer",
            (
                "c_custkey",
                "case when c_custkey % 50 <> 7 then c_name end as first_name",
                "case when c_custkey % 50 <> 11 then concat(lower(replace(c_name, '#', '.')), '@example.com') end as email",
                "case when c_custkey % 50 <> 13 then concat('98', lpad(cast((c_custkey * 7919) % 100000000 as string), 8, '0')) end as phone",
                "case when c_custkey % 50 <> 17 then c_acctbal end as salary",
                "case when c_custkey % 50 <> 19 then c_name end as password",
                "c_mktsegment as department",
            ),
            None,
        )
    ],
    "dirty": [
        (
            "customer",
            (
                "c_custkey",
                "case when c_custkey % 13 = 0 then null else c_name end as c_name",
                "case when c_custkey % 11 = 0 then -1 else c_nationkey end as c_nationkey",
                "case when c_custkey % 19 = 0 then 'n/a' else cast(cast(c_acctbal as decimal(12,2)) as string) end as c_acctbal",
                "c_mktsegment",
                "0 as copy_no",
            ),
            None,
        ),
        (
            "customer",
            (
                "c_custkey",
                "c_name",
                "c_nationkey",
                "cast(cast(c_acctbal as decimal(12,2)) as string) as c_acctbal",
                "c_mktsegment",
                "case when c_custkey % 3 = 0 then 0 when c_custkey % 5 = 0 then cast(null as int) else 1 end as copy_no",
            ),
            "c_custkey % 17 = 0",
        ),
    ],
    "ledger": [
        (
            "orders",
            (*_LEDGER_TAIL, "'PENDING' as status", "cast(0 as bigint) as rows_done", "cast(null as string) as error", "o_orderdate as noted_at"),
            None,
        ),
        (
            "orders",
            (*_LEDGER_TAIL, "'RUNNING' as status", "cast(0 as bigint) as rows_done", "cast(null as string) as error", "o_orderdate + interval 60 second as noted_at"),
            "o_orderkey % 5 <> 2",
        ),
        (
            "orders",
            (
                *_LEDGER_TAIL,
                "case when o_orderkey % 5 = 0 then 'FAILED' else 'COMPLETED' end as status",
                "cast(case when o_orderkey % 5 = 0 then 0 else o_orderkey % 1000 end as bigint) as rows_done",
                "case when o_orderkey % 5 = 0 then concat('lost connection ', cast(o_orderkey as string)) end as error",
                "o_orderdate + interval 120 second as noted_at",
            ),
            "o_orderkey % 5 not in (1, 2)",
        ),
    ],
    "drift": [
        (
            "orders",
            (
                "o_orderkey as event_id",
                "o_custkey as migration_id",
                _pick("o_orderkey % 6", "CREATE_TABLE", "DROP_TABLE", "ADD_COLUMN", "DROP_COLUMN", "ALTER_TABLE", "CREATE_INDEX") + " as change_type",
                _pick("o_orderkey % 6", "MODERATE", "CRITICAL", "MODERATE", "HIGH", "HIGH", "SAFE") + " as risk_level",
                "concat('t_', cast(o_orderkey as string)) as table_name",
                "case when o_orderkey % 6 > 1 then o_orderpriority end as object_name",
                "o_orderkey % 6 not in (2, 5) as approval_required",
                _pick("o_orderkey % 8", "APPROVED", "REJECTED", "IGNORED", "APPLIED", "DETECTED") + " as status",
                "o_orderdate as detected_at",
            ),
            None,
        )
    ],
    "decisions": [
        (
            "events",
            (
                "event_id as decision_id",
                "cast(floor(event_id / 2) as bigint) as event_id",
                _pick("event_id % 3", "APPROVED", "REJECTED", "IGNORED") + " as decision",
                "concat('user_', cast(user_id as string)) as decided_by",
                "ts as decided_at",
                "case when event_id % 3 = 1 then props end as reason",
            ),
            None,
        )
    ],
    "status_updates": [
        (
            "events",
            (
                "event_id as update_id",
                "user_id as migration_id",
                "case event_id % 6 when 0 then 'RUNNING' when 1 then null when 2 then 'PAUSED' when 3 then null when 4 then 'COMPLETED' else 'FAILED' end as status",
                "case when event_id % 4 <> 3 then cast(event_id % 100 as double) end as progress_percent",
                "case when event_id % 5 <> 2 then event_id * 10 end as rows_migrated",
                "case when event_id % 6 = 5 then concat('step failed ', cast(event_id as string)) end as error",
                "ts as noted_at",
            ),
            None,
        )
    ],
    "error_log": [
        (
            "events",
            (
                "event_id",
                "case when event_type = 'error' then concat('(1045) refused for user u', cast(user_id as string))"
                " when event_type = 'click' and event_id % 2 = 0 then 'connection TIMED OUT while reading'"
                " when event_type = 'click' then '[WinError 10060] no answer'"
                " when event_type = 'view' and event_id % 2 = 0 then concat('Unknown Database db_', cast(user_id as string))"
                " when event_type = 'view' then 'Access Denied, error 1049'"
                " else concat('disk full at ', props) end as message",
            ),
            None,
        )
    ],
    "poll_log": [
        (
            "events",
            (
                "event_id % 20 as migration_id",
                "event_id as batch_id",
                "case when event_type in ('error', 'click', 'view') and event_id % 40 < 34 then 'ERROR'"
                " when event_type = 'signup' then 'EMPTY' when event_id % 3 = 0 then 'APPLIED' else 'EMPTY' end as outcome",
                "ts as noted_at",
            ),
            None,
        )
    ],
}

# Catalog rows: one table per order in the database of its customer.
_COLUMNS = (
    # name, type, nullable, primary key, length, precision, scale, default, auto increment
    ("id", "integer", False, True, None, None, None, None, True),
    ("user_id", "integer", False, False, None, None, None, None, False),
    ("total", "decimal", False, False, None, 10, 2, "0", False),
    ("status", "varchar", True, False, 50, None, None, None, False),
    ("user_email", "varchar", True, False, 255, None, None, None, False),
    ("photo", "blob", True, False, None, None, None, None, False),
    ("created_at", "timestamp", False, False, None, None, None, "CURRENT_TIMESTAMP", False),
)
_INDEXES = ("pkey", "user_idx", "status_idx")


def _literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    return f"'{value}'" if isinstance(value, str) else str(value)


def _catalog_columns(after: bool) -> list[tuple[str, tuple[str, ...], str | None]]:
    rules = []
    for ordinal, (name, kind, nullable, pk, length, precision, scale, default, auto) in enumerate(_COLUMNS, 1):
        length_sql, precision_sql, kind_sql, keep = _literal(length), _literal(precision), _literal(kind), "true"
        if after and name == "total":
            precision_sql = "case when o_orderkey % 13 = 0 then 18 else 10 end"
        if after and name == "user_id":
            kind_sql = "case when o_orderkey % 7 = 0 then 'bigint' else 'integer' end"
        if after and name == "status":
            keep = "o_orderkey % 11 <> 0"
            length_sql = "case when o_orderkey % 9 = 0 then 80 else 50 end"
        if not after and name == "user_email":
            keep = "o_orderkey % 10 <> 0"
        key_sql = "o_orderkey % 4 < 3" if name == "id" else "o_orderkey % 4 > 1" if name == "user_id" else "false"
        rules.append(
            (
                "orders",
                (
                    *_CATALOG_KEY,
                    f"{ordinal} as ordinal",
                    f"'{name}' as column_name",
                    f"{kind_sql} as column_type",
                    f"{_literal(nullable)} as nullable",
                    f"{key_sql} as primary_key",
                    f"cast({length_sql} as int) as max_length",
                    f"cast({precision_sql} as int) as num_precision",
                    f"cast({_literal(scale)} as int) as num_scale",
                    f"cast({_literal(default)} as string) as column_default",
                    f"{_literal(auto)} as auto_increment",
                ),
                f"{keep} and {_table_kept(after)}",
            )
        )
    return rules


def _table_kept(after: bool) -> str:
    """Tables dropped between the snapshots, and tables only the later one has."""
    return "o_orderkey % 17 <> 0" if after else "o_orderkey % 19 <> 0"


def _catalog_indexes(after: bool) -> list[tuple[str, tuple[str, ...], str | None]]:
    rules = []
    for name in _INDEXES:
        keep = "true"
        if after and name == "user_idx":
            keep = "o_orderkey % 23 <> 0"
        if not after and name == "status_idx":
            keep = "o_orderkey % 3 <> 0"
        rules.append(
            (
                "orders",
                (*_CATALOG_KEY, f"concat('t_', cast(o_orderkey as string), '_{name}') as index_name"),
                f"{keep} and {_table_kept(after)}",
            )
        )
    return rules


_FK = "concat('t_', cast(o_orderkey as string), '_user_fk')"
RULES.update(
    {
        "columns_before": _catalog_columns(False),
        "columns_after": _catalog_columns(True),
        "indexes_before": _catalog_indexes(False),
        "indexes_after": _catalog_indexes(True),
        "table_constraints": [
            ("orders", (*_CATALOG_KEY, f"{_FK} as constraint_name", "'FOREIGN KEY' as constraint_type"), "o_orderkey % 3 <> 1"),
            ("orders", (*_CATALOG_KEY, "concat('t_', cast(o_orderkey as string), '_pkey') as constraint_name", "'PRIMARY KEY' as constraint_type"), None),
        ],
        "key_columns": [
            ("orders", (*_CATALOG_KEY, f"{_FK} as constraint_name", "'user_id' as column_name", "1 as ordinal"), None),
            ("orders", (*_CATALOG_KEY, f"{_FK} as constraint_name", "'tenant_id' as column_name", "2 as ordinal"), "o_orderkey % 5 = 0"),
            ("orders", (*_CATALOG_KEY, "concat('t_', cast(o_orderkey as string), '_pkey') as constraint_name", "'id' as column_name", "1 as ordinal"), None),
        ],
        "referenced_columns": [
            ("orders", (*_CATALOG_KEY, f"{_FK} as constraint_name", "'users' as referenced_table", "'id' as referenced_column", "1 as ordinal"), None),
            ("orders", (*_CATALOG_KEY, f"{_FK} as constraint_name", "'users' as referenced_table", "'tenant' as referenced_column", "2 as ordinal"), "o_orderkey % 5 = 0"),
        ],
        "catalog_tables": [
            (
                "orders",
                (
                    "case when o_orderkey % 9 = 0 then 'pg_catalog' when o_orderkey % 9 = 1 then 'information_schema' else 'public' end as table_schema",
                    "concat('t_', cast(o_orderkey as string)) as table_name",
                    "case when o_orderkey % 7 = 0 then 'VIEW' else 'BASE TABLE' end as table_type",
                ),
                None,
            )
        ],
    }
)


class Inputs:
    """Given and derived tables of one folder, each read only when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(self.path(name))
        if name not in RULES:
            raise AttributeError(name)
        rules = RULES[name]
        given = getattr(self, rules[0][0])
        if len(rules) == 1:
            _, expressions, condition = rules[0]
            return (given.where(condition) if condition else given).selectExpr(*expressions)
        # All parts of a rule read the same table: one scan, one row per part that applies.
        parts = [
            F.when(F.expr(condition or "true"), F.struct(*[F.expr(e) for e in expressions]))
            for _, expressions, condition in rules
        ]
        return given.select(F.inline(F.array_compact(F.array(*parts))))


def as_sql(name: str) -> str:
    """The rule of a derived table as query text."""
    parts = [
        f"select {', '.join(expressions)} from {given}" + (f" where {condition}" if condition else "")
        for given, expressions, condition in RULES[name]
    ]
    return " union all ".join(parts)


def with_tables(query: str, *names: str) -> str:
    """Query text with the derived tables it names put in front. Query text that
    starts with ``with`` or a comma goes on with tables of its own."""
    head = "with " + ", ".join(f"{n} as ({as_sql(n)})" for n in names)
    if query.startswith("with "):
        return f"{head}, {query[5:]}"
    return f"{head}{query}" if query.startswith(",") else f"{head} {query}"
