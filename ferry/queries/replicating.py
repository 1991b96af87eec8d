"""Change data capture, in batches and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferry.inputs import Inputs
from ferry.operators import metrics, notify
from ferry.plans.copy import CopyPlan
from ferry.queries.registry import query
from ferry.session import fresh_dir
from ferry.sources import target as store
from ferry.streaming import changes, silence, snapshot

ROW = "id bigint, value double, k int"
_CHANGES = ("change_events",)

# Last change per key wins; keys never changed keep the loaded row.
_LAST = """last as (select * exclude (rn) from (select *, row_number() over (partition by id order by event_id desc) as rn
    from (select coalesce(cast(json_extract_string(before_data, '$.id') as bigint), cast(json_extract_string(after_data, '$.id') as bigint)) as id,
      event_id, operation, after_data from change_events)) where rn = 1)"""
_APPLIED = """select id, cast(json_extract_string(after_data, '$.value') as double) as value, cast(json_extract_string(after_data, '$.k') as int) as k
  from last where operation <> 'DELETE'"""
_LOADED_AND_APPLIED = (
    f", {_LAST} {_APPLIED} union all select c_custkey, c_acctbal, 0 from customer where c_custkey not in (select id from last)"
)


def _loaded(t: Inputs):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.lit(0).alias("k"))


#: Change events in one dropped file, which one task sorts and writes.
EVENTS_PER_FILE = 500_000


def _drop(t: Inputs, files: int) -> tuple[str, int]:
    """All change events as files in a folder, as a capture process leaves them, and how
    many of the files are half of them. With more events come more files, not larger ones."""
    folder = fresh_dir(t.spark, "drop")
    files = max(files, -(-t.change_events.count() // EVENTS_PER_FILE))
    t.change_events.repartitionByRange(files, "event_id").sortWithinPartitions("event_id").write.parquet(folder)
    return folder, -(-files // 2)


@query(
    "changes_in_order",
    """select event_id, migration_id, lsn_num, rn as place from (select *, row_number() over (partition by migration_id order by lsn_num, event_id) as rn
         from (select event_id, migration_id, cast('0x' || split_part(lsn, '/', 1) as bigint) * 4294967296 + cast('0x' || split_part(lsn, '/', 2) as bigint) as lsn_num
           from change_events where status = 'PENDING')) where rn <= 1000""",
    _CHANGES,
)
def changes_in_order(t: Inputs):
    return changes.changes_in_order(t.change_events, 1000).select(
        "event_id", "migration_id", F.col("lsn_num").cast("bigint").alias("lsn_num"), F.col("row_rank").cast("bigint").alias("place")
    )


@query(
    "record_change_events",
    """select event_id, case when event_id % 11 = 0 then 'unknown operation' when event_id % 13 = 0 then 'bad after image' else '' end
           || case when event_id % 11 = 0 and event_id % 13 = 0 then '; bad after image' else '' end as reasons,
         event_id % 11 <> 0 and event_id % 13 <> 0 as recorded, case when event_id % 11 <> 0 and event_id % 13 <> 0 then operation end as operation from change_events""",
    _CHANGES,
)
def record_change_events(t: Inputs):
    number = F.col("event_id")
    raw = t.change_events.withColumn(
        "operation",
        F.when(number % 11 == 0, "TRUNCATE").otherwise(F.concat(F.lit(" "), F.lower("operation"))),
    ).withColumn("after_data", F.when(number % 13 == 0, F.lit("{broken")).otherwise(F.col("after_data")))
    good, bad = changes.record_changes(raw)
    kept = good.select("event_id", F.lit("").alias("reasons"), F.lit(True).alias("recorded"), "operation")
    return kept.unionByName(
        bad.select("event_id", F.array_join("reasons", "; ").alias("reasons"), F.lit(False).alias("recorded"), F.lit(None).cast("string").alias("operation"))
    )


@query("dedupe_events", "select event_id, lsn, operation from change_events", _CHANGES)
def dedupe_events(t: Inputs):
    again = t.change_events.where("event_id % 3 = 0")
    return changes.dedupe_changes(t.change_events.unionByName(again)).select("event_id", "lsn", "operation")


@query("cdc_apply_batch", _LOADED_AND_APPLIED, _CHANGES)
def cdc_apply_batch(t: Inputs):
    root = fresh_dir(t.spark, "replica")
    return changes.replicate(t.spark, root, "FULL_LOAD_AND_CDC", _loaded(t), [t.change_events], ROW, "id")


@query("cdc_apply_changes_only", f", {_LAST} {_APPLIED}", _CHANGES)
def cdc_apply_changes_only(t: Inputs):
    root = fresh_dir(t.spark, "replica")
    return changes.replicate(t.spark, root, "CDC_ONLY", _loaded(t), [t.change_events], ROW, "id")


@query("cdc_full_load_then_changes", _LOADED_AND_APPLIED, _CHANGES)
def cdc_full_load_then_changes(t: Inputs):
    """Three batches that overlap and arrive out of order."""
    events = t.change_events
    third = events.agg(F.max("event_id")).first()[0] // 3
    number = F.col("event_id")
    batches = [events.where(number <= 2 * third), events.where(number <= third), events.where(number > third)]
    return changes.replicate(t.spark, fresh_dir(t.spark, "replica"), "FULL_LOAD_AND_CDC", _loaded(t), batches, ROW, "id")


@query("cdc_load_between_changes", _LOADED_AND_APPLIED, _CHANGES)
def cdc_load_between_changes(t: Inputs):
    """A load in two spans of keys. Each span is read at a later state of the table than its
    mark says. A third of the changes is applied before the load, the last third first; what
    is loaded meets the target after the first span, and at the end."""
    load, root, events = fresh_dir(t.spark, "load"), fresh_dir(t.spark, "replica"), t.change_events
    last = events.agg(F.max("event_id")).first()[0]
    third = [-1, last // 3, 2 * last // 3, last]
    plan = CopyPlan(1, "customer", "id", max(1, t.customer.count() // 6))

    def table_after(event: int):
        """The source table once the events up to this one have happened."""
        done = changes.collapse_changes(changes.keyed_changes(events.where(F.col("event_id") <= event), ROW, "id"), "id")
        kept = _loaded(t).join(done, "id", "left_anti")
        path = fresh_dir(t.spark, "source")
        kept.unionByName(done.where(~F.col("_deleted")).select(*kept.columns)).write.parquet(path)
        return t.spark.read.parquet(path)

    def apply_third(i: int) -> None:
        now = events.where((F.col("event_id") > third[i]) & (F.col("event_id") <= third[i + 1]))
        changes.apply_changes(t.spark, root, now, ROW, "id", f"changes-{i}")

    apply_third(2)
    spans = snapshot.key_spans(_loaded(t), plan, 2)
    for i, span in enumerate(spans):
        mark = snapshot.last_position(events.where(F.col("event_id") <= third[i]))
        snapshot.load_span(t.spark, table_after(third[i + 1]), load, plan, span, mark, "2024-01-01 00:00:00")
        snapshot.apply_load(t.spark, load, root, ["id"], f"load-{i}")
        apply_third(i)
    for i in range(len(spans), 2):
        apply_third(i)
    return store.read_target(t.spark, root)


@query(
    "cdc_late_events",
    """, x as (select event_id, coalesce(cast(json_extract_string(before_data, '$.id') as bigint), cast(json_extract_string(after_data, '$.id') as bigint)) as id from change_events),
       h as (select id, max(event_id) as held from x where event_id % 2 = 0 group by 1)
       select event_id, 'SKIPPED' as status from x join h using (id) where event_id <= held""",
    _CHANGES,
)
def cdc_late_events(t: Inputs):
    """Events the target is already past, once every other event was applied."""
    root = fresh_dir(t.spark, "replica")
    changes.apply_changes(t.spark, root, t.change_events.where("event_id % 2 = 0"), ROW, "id", "even")
    held = store.read_target(t.spark, root, control=True)
    return changes.late_changes(t.change_events, held, ROW, "id")


@query(
    "cdc_partial_images",
    """, e as (select *, coalesce(cast(json_extract_string(before_data, '$.id') as varchar), cast(json_extract_string(after_data, '$.id') as varchar)) as id from change_events),
       d as (select id, max(event_id) as gone from e where operation = 'DELETE' group by 1),
       v as (select cast(json_extract_string(after_data, '$.id') as varchar) as id, event_id, after_data from change_events where operation <> 'DELETE'),
       f as (select id, event_id, 'id' as field, id as value from v
         union all select id, event_id, 'value', json_extract_string(after_data, '$.value') from v where event_id % 2 = 0
         union all select id, event_id, 'k', json_extract_string(after_data, '$.k') from v where event_id % 2 = 1)
       select id, field, arg_max(value, event_id) as value from f left join d using (id) where gone is null or event_id > gone group by 1, 2""",
    _CHANGES,
)
def cdc_partial_images(t: Inputs):
    """After images that hold only some of the fields; deletes end a row's history."""
    image = changes.decode_image(F.col("after_data"), "id string, value string, k string")
    cut = F.to_json(
        F.struct(
            image["id"].alias("id"),
            F.when(F.col("event_id") % 2 == 0, image["value"]).alias("value"),
            F.when(F.col("event_id") % 2 == 1, image["k"]).alias("k"),
        )
    )
    events = t.change_events.withColumn("after_data", F.when(F.col("after_data").isNotNull(), cut))
    return changes.collapse_partial_changes(events, "id")


# Three tables whose keys collide, positions in decimal, events no target can take.
_SHOPS = ("users", "orders", "products")
_MIXED = """, m as (select * replace (['users', 'orders', 'products', 'invoices'][event_id % 4 + 1] as table_name,
         case when event_id % 31 = 0 then null when event_id % 37 = 0 then '{"id":"x"}' when event_id % 41 = 0 then '{"id":' else after_data end as after_data,
         case when event_id % 31 = 0 then null else before_data end as before_data) from change_events),
       reasoned as (select *, case when table_name = 'invoices' then 'unknown table' when event_id % 31 = 0 then 'no key'
         when event_id % 41 = 0 and event_id % 37 <> 0 then 'bad after image' when event_id % 37 = 0 then
           'after image does not fit' || case when operation <> 'DELETE' or before_data is null then '; no key' else '' end else '' end as reasons from m)"""


def _mixed(t: Inputs):
    number = F.col("event_id")
    after = F.when(number % 31 == 0, None).when(number % 37 == 0, '{"id":"x"}').when(number % 41 == 0, '{"id":').otherwise(F.col("after_data"))
    return (
        t.change_events.withColumn("table_name", F.element_at(F.array(*map(F.lit, (*_SHOPS, "invoices"))), (number % 4 + 1).cast("int")))
        .withColumn("after_data", after)
        .withColumn("before_data", F.when(number % 31 != 0, F.col("before_data")))
        .withColumn("lsn", F.concat(F.lit("1764594785/"), number.cast("string")))
    )


@query(
    "cdc_apply_tables",
    f"""{_MIXED}, x as (select *, coalesce(try_cast(json_extract_string(before_data, '$.id') as bigint), try_cast(json_extract_string(after_data, '$.id') as bigint)) as id
         from reasoned where reasons = ''),
       last as (select * from x qualify row_number() over (partition by table_name, id order by event_id desc) = 1)
       select table_name, id, cast(json_extract_string(after_data, '$.value') as double) as value, cast(json_extract_string(after_data, '$.k') as int) as k, '' as reasons
       from last where operation <> 'DELETE'
       union all select table_name, event_id, null, null, reasons from reasoned where reasons <> ''""",
    _CHANGES,
)
def cdc_apply_tables(t: Inputs):
    """A stream of three tables: their rows, and the events held back with the reasons."""
    root, folder = fresh_dir(t.spark, "replica"), fresh_dir(t.spark, "drop")
    _mixed(t).write.parquet(folder)
    stream = changes.change_source(t.spark, folder)
    wanted = {name: (ROW, "id") for name in _SHOPS}
    changes.start_apply(stream, root, fresh_dir(t.spark, "stream"), base=10, tables=wanted).awaitTermination()
    held = t.spark.read.parquet(f"{root}/quarantine").select(
        "table_name", F.col("event_id").alias("id"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("int").alias("k"),
        F.array_join("reasons", "; ").alias("reasons"),
    )
    for name in _SHOPS:
        rows = store.read_target(t.spark, changes.table_root(root, name))
        held = held.unionByName(rows.select(F.lit(name).alias("table_name"), "id", "value", "k", F.lit("").alias("reasons")))
    return held


@query("cdc_source", "select * from change_events", _CHANGES)
def cdc_source(t: Inputs):
    """Poll a folder in micro-batches and append what comes in."""
    out = fresh_dir(t.spark, "polled")
    folder, half = _drop(t, 4)
    stream = changes.change_source(t.spark, folder, files_per_batch=half)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", fresh_dir(t.spark, "stream"))
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return t.spark.read.parquet(out)


@query("cdc_apply", _LOADED_AND_APPLIED, _CHANGES)
def cdc_apply(t: Inputs):
    root = fresh_dir(t.spark, "replica")
    changes.replicate(t.spark, root, "FULL_LOAD", _loaded(t), [], ROW, "id")
    folder, half = _drop(t, 2)
    stream = changes.change_source(t.spark, folder, files_per_batch=half)
    changes.start_apply(stream, root, fresh_dir(t.spark, "stream"), ROW, "id").awaitTermination()
    return store.read_target(t.spark, root)


@query("cdc_resume", f", {_LAST} {_APPLIED}", _CHANGES)
def cdc_resume(t: Inputs):
    """Run, stop, more events arrive, start again from the same checkpoint."""
    root, checkpoint, folder = (fresh_dir(t.spark, n) for n in ("replica", "stream", "drop"))
    events = t.change_events
    half = events.agg(F.max("event_id")).first()[0] // 2
    for part in (events.where(F.col("event_id") <= half), events.where(F.col("event_id") > half)):
        part.write.mode("append").parquet(folder)
        stream = changes.change_source(t.spark, folder)
        changes.start_apply(stream, root, checkpoint, ROW, "id").awaitTermination()
    return store.read_target(t.spark, root)


@query(
    "progress_feed",
    """select migration_id, count(*) as total_events, count(*) filter (where status = 'PENDING') as pending_events,
         count(*) filter (where status = 'PROCESSED') as processed_events, count(*) filter (where status = 'FAILED') as failed_events
       from change_events group by 1""",
    _CHANGES,
)
def progress_feed(t: Inputs):
    feed = fresh_dir(t.spark, "feed")
    folder, half = _drop(t, 4)
    stream = changes.change_source(t.spark, folder, files_per_batch=half)
    changes.start_progress_feed(stream, feed, fresh_dir(t.spark, "stream")).awaitTermination()
    return changes.read_feed(t.spark, feed)


@query(
    "mark_events",
    """select event_id, migration_id, case when event_id % 4 = 0 then 'FAILED' when event_id % 4 < 3 then 'PROCESSED' else status end as status,
         retry_count + case when event_id % 4 = 0 then 1 else 0 end as retry_count,
         case when event_id % 4 in (1, 2) then change_timestamp + interval 5 second else processed_at end as processed_at,
         case when event_id % 4 = 0 then 'constraint on ' || event_id end as error_message from change_events""",
    _CHANGES,
)
def mark_events(t: Inputs):
    number = F.col("event_id")
    outcomes = t.change_events.where(number % 4 < 3).select(
        "event_id",
        (number % 4 == 0).alias("failed"),
        F.expr("change_timestamp + interval 5 second").alias("at"),
        F.concat(F.lit("constraint on "), number.cast("string")).alias("error"),
    )
    return changes.mark_changes(t.change_events, outcomes)


_LAGS = """select migration_id, table_name, max(cast(epoch(processed_at - change_timestamp) as bigint)) as max_lag_seconds,
    round(sum(cast(epoch(processed_at - change_timestamp) as bigint)) / cast(count(*) as double), 6) as avg_lag_seconds,
    arg_max(lsn, event_id) as last_lsn, max(processed_at) as last_sync_at from change_events where status = 'PROCESSED' group by 1, 2"""


@query("replication_lag", _LAGS, _CHANGES)
def replication_lag(t: Inputs):
    return changes.replication_lag(t.change_events)


@query(
    "high_lag_alerts",
    f"select 'HIGH_REPLICATION_LAG' as event_type, migration_id, table_name, max_lag_seconds, last_lsn from ({_LAGS}) where max_lag_seconds > 590",
    _CHANGES,
)
def high_lag_alerts(t: Inputs):
    return changes.high_lag_alerts(changes.replication_lag(t.change_events), 590)


@query(
    "fan_out_subscriptions",
    f"""with a as (select 'HIGH_REPLICATION_LAG' as event_type, migration_id, table_name, max_lag_seconds, last_lsn from ({_LAGS}) where max_lag_seconds > 590)
       select s.config_id, s.notification_type, a.*, 'PENDING' as status
       from a join subscriptions s on s.enabled and (s.subscribed_events = '[]' or contains(s.subscribed_events, '"' || a.event_type || '"'))""",
    (*_CHANGES, "subscriptions"),
)
def fan_out_subscriptions(t: Inputs):
    """Every alert of a lagging table goes to everyone subscribed to such alerts."""
    alerts = changes.high_lag_alerts(changes.replication_lag(t.change_events), 590)
    return notify.fan_out(alerts, t.subscriptions, salts=16)


@query(
    "event_rate_windows",
    """select date_trunc('minute', change_timestamp) as window_start, date_trunc('minute', change_timestamp) + interval 1 minute as window_end,
         operation, count(*) as events from change_events group by 1, 2, 3""",
    _CHANGES,
)
def event_rate_windows(t: Inputs):
    return changes.event_rate_windows(t.change_events)


@query(
    "stale_workers",
    """select user_id as worker_id, max(ts) as last_seen, cast(floor(epoch(timestamp '2024-01-31' - max(ts))) as bigint) as silent_seconds from events
       group by 1 having floor(epoch(timestamp '2024-01-31' - max(ts))) > 43200""",
)
def stale_workers(t: Inputs):
    beats = t.events.select(F.col("user_id").alias("worker_id"), F.col("ts").alias("seen_at"))
    return metrics.stale_workers(beats, "2024-01-31 00:00:00", 43200)


_SILENCE = """with b as (select user_id as worker_id, ts, lag(ts) over (partition by user_id order by ts) as prev from events),
       l as (select user_id as worker_id, max(ts) as prev from events group by 1)
       select worker_id, 'SILENT' as notice, prev as since, prev + interval 43200 second as told_at from b where ts - prev > interval 43200 second
       union all select worker_id, 'BACK', prev, ts from b where ts - prev > interval 43200 second
       union all select worker_id, 'SILENT', prev, prev + interval 43200 second from l where (select max(ts) from events) - prev > interval 43200 second"""


@query("silence_notices", _SILENCE)
def silence_notices(t: Inputs):
    """Every silence of more than twelve hours, and the beat that ends it."""
    beats = t.events.select(F.col("user_id").alias("worker_id"), F.col("ts").alias("seen_at"))
    return silence.silence_notices(beats, beats.agg(F.max("seen_at")).first()[0], 43200)


@query("silence_watch", _SILENCE)
def silence_watch(t: Inputs):
    """The same from a stream that is stopped twice: beats of a worker may fall silent in
    one run and come back in a later one."""
    root, checkpoint, folder = (fresh_dir(t.spark, n) for n in ("watch", "stream", "drop"))
    beats = t.events.select(F.col("user_id").alias("worker_id"), F.col("ts").alias("seen_at"))
    first, second = F.lit("2024-01-09 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-19 12:00:00").cast("timestamp_ntz")
    at = F.col("seen_at")
    for part in (beats.where(at < first), beats.where((at >= first) & (at < second)), beats.where(at >= second)):
        part.write.mode("append").parquet(folder)
        stream = changes.change_source(t.spark, folder, schema=beats.schema)
        silence.start_silence_watch(stream, root, checkpoint, 43200).awaitTermination()
    return silence.read_notices(t.spark, root)
