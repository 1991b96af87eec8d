"""Scans, sinks, planning and copying."""

from __future__ import annotations

from pyspark.sql import Window, functions as F, types as T

from ferry.functions import convert, numbers, text
from ferry.inputs import GIVEN, Inputs
from ferry.operators import explore, mask, ordered, quality
from ferry.plans import chunks, copy
from ferry.queries.registry import query
from ferry.session import fresh_dir
from ferry.sources import sinks, tables, target

_COUNTED = " union all ".join(f"select '{n}' as table_name, count(*) as row_count from {n}" for n in GIVEN)


def _row_counts(t: Inputs):
    from ferry.operators.verify import table_row_counts

    return table_row_counts({n: getattr(t, n) for n in GIVEN})


# ---- scans -----------------------------------------------------------------

@query("scan_table", "select * from lineitem")
def scan_table(t: Inputs):
    return tables.scan_table(t.spark, t.path("lineitem"))


@query(
    "scan_chunk",
    "select *, cast(floor(o_orderkey / (select ceil((max(o_orderkey) + 1) / 4.0) from orders)) as int) as chunk_no from orders",
)
def scan_chunk(t: Inputs):
    top = t.orders.agg(F.max("o_orderkey")).first()[0] or 0
    step = -(-(top + 1) // 4)
    parts = [
        tables.scan_chunk(t.orders, "o_orderkey", i * step, (i + 1) * step).withColumn("chunk_no", F.lit(i)) for i in range(4)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("scan_columns", "select l_orderkey, l_quantity, l_shipdate from lineitem")
def scan_columns(t: Inputs):
    return tables.scan_columns(t.lineitem, ["l_shipdate", "l_orderkey", "l_quantity"])


@query(
    "preview_rows",
    """select c_custkey,
         coalesce(first_name, null) as first_name,
         case when email is null then 'NULL' when length(split_part(email, '@', 1)) <= 1 then '***@' || split_part(email, '@', 2)
              else substr(email, 1, 1) || '***@' || split_part(email, '@', 2) end as email,
         case when phone is null then 'NULL' else substr(phone, 1, 2) || repeat('*', length(phone) - 4) || substr(phone, length(phone) - 1) end as phone,
         case when salary is null then 'NULL' else '*****' end as salary,
         case when password is null then 'NULL' else '********' end as password,
         department
       from people order by c_custkey limit 5""",
    ("people",),
)
def preview_rows(t: Inputs):
    return mask.preview_rows(t.people.withColumn("photo", F.col("department").cast("binary")), "c_custkey", 5)


_STORED = {
    "region": "r_regionkey:integer r_name:varchar",
    "nation": "n_nationkey:integer n_name:varchar n_regionkey:integer",
    "customer": "c_custkey:bigint c_name:varchar c_nationkey:integer c_acctbal:double c_mktsegment:varchar",
    "supplier": "s_suppkey:bigint s_name:varchar s_nationkey:integer s_acctbal:double",
    "part": "p_partkey:bigint p_name:varchar p_brand:varchar p_type:varchar p_size:integer p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:varchar o_totalprice:double o_orderdate:timestamp o_orderpriority:varchar",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:integer l_quantity:double l_extendedprice:double"
    " l_discount:double l_tax:double l_returnflag:varchar l_linestatus:varchar l_shipdate:timestamp",
    "events": "event_id:bigint ts:timestamp user_id:bigint event_type:varchar value:double props:varchar",
    "documents": "doc_id:bigint text:varchar lang:varchar source:varchar n_chars:bigint",
    "embeddings": "vec_id:bigint embedding:array<float> label:integer",
    "pages": "page_id:bigint url:varchar html:varchar",
    "benchmark": "item_id:bigint text:varchar",
    "labels": "doc_id:bigint quality:integer toxic:integer",
    "conversations": "conv_id:bigint turn:bigint role:varchar text:varchar",
    "dirty": "c_custkey:bigint c_name:varchar c_nationkey:integer c_acctbal:varchar c_mktsegment:varchar copy_no:integer",
}


def _catalog_sql(table: str, columns: list[list[str]]) -> str:
    listed = ", ".join(f"{{'i': {i}, 'n': '{n}', 't': '{kind}', 'nulls': count(*) - count({n})}}" for i, (n, kind) in enumerate(columns, 1))
    return (
        f"select '{table}' as table_name, c.n as column_name, c.i as ordinal, c.t as column_type, true as nullable, cast(null as int) as num_precision,"
        f" cast(null as int) as num_scale, row_count, c.nulls as null_count from (select count(*) as row_count, unnest([{listed}]) as c from {table})"
    )


@query(
    "scan_catalog",
    " union all ".join(_catalog_sql(n, [c.split(":") for c in columns.split()]) for n, columns in _STORED.items()),
    ("dirty",),
)
def scan_catalog(t: Inputs):
    # `dirty` adds a literal column; a stored table reports its columns as nullable.
    stored = fresh_dir(t.spark, "stored")
    t.dirty.write.parquet(stored)
    return tables.scan_catalog(t.spark, {n: getattr(t, n) for n in GIVEN} | {"dirty": t.spark.read.parquet(stored)})


# ---- sinks -----------------------------------------------------------------

@query("append_rows", "select * from source_orders union all select * from target_orders", ("source_orders", "target_orders"))
def append_rows(t: Inputs):
    path = fresh_dir(t.spark, "append")
    sinks.append_rows(t.source_orders, path)
    sinks.append_rows(t.target_orders, path)
    return t.spark.read.parquet(path)


def _incoming(t: Inputs):
    """Source rows, some of them repeated in the batch with a later value."""
    first = t.source_orders.withColumn("seq", F.lit(0))
    again = t.source_orders.where("o_orderkey % 89 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return first.unionByName(again.withColumn("seq", F.lit(1)))


@query(
    "upsert_rows",
    """select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 89 = 0 then o_totalprice * 2 else o_totalprice end as o_totalprice,
         o_orderdate, o_orderpriority, case when o_orderkey % 89 = 0 then 1 else 0 end as seq from orders
       union all
       select *, -1 from target_orders where o_orderkey not in (select o_orderkey from orders)""",
    ("target_orders",),
)
def upsert_rows(t: Inputs):
    root = fresh_dir(t.spark, "target")
    target.upsert(t.spark, root, t.target_orders.withColumn("seq", F.lit(-1)), ["o_orderkey"], "load")
    target.upsert(t.spark, root, _incoming(t), ["o_orderkey"], "batch-1", order=["seq"])
    return target.read_target(t.spark, root)


# Rules first; of the rows that keep them, a key's first one is loaded unless two tie for it.
_CHECKED = """, r as (select *, row_number() over () as rn, list_filter([
           case when c_name is null then 'c_name is null' end,
           case when c_nationkey = -1 then 'c_nationkey is not allowed' end,
           case when c_acctbal = 'n/a' then 'c_acctbal is not double' end], lambda x: x is not null) as broken from dirty),
       f as (select rn, count(*) over k as copies, min(copy_no) over k as first_no,
           count(*) over (partition by c_custkey, copy_no) as ties from r where len(broken) = 0 window k as (partition by c_custkey)),
       checked as (select r.*, case when len(broken) > 0 then array_to_string(broken, '; ') when copies = 1 then ''
           when first_no is null then 'ambiguous copy' when copy_no is null or copy_no > first_no then 'duplicate key'
           when ties > 1 then 'ambiguous copy' else '' end as reasons from r left join f using (rn))"""


@query(
    "load_with_quarantine",
    f"{_CHECKED} select c_custkey, copy_no, reasons, reasons = '' as loaded from checked",
    ("dirty",),
)
def load_with_quarantine(t: Inputs):
    rules = [
        quality.not_null("c_name"),
        quality.one_of("c_nationkey", range(25)),
        quality.castable("c_acctbal", "double"),
        quality.max_length("c_mktsegment", 40),
    ]
    good, bad = quality.split_rows(quality.check_rows(t.dirty, rules, "c_custkey", "copy_no"))
    loaded = good.select("c_custkey", "copy_no", F.lit("").alias("reasons"), F.lit(True).alias("loaded"))
    held = bad.select("c_custkey", "copy_no", F.array_join("reasons", "; ").alias("reasons"), F.lit(False).alias("loaded"))
    return loaded.unionByName(held)


@query("create_target_if_missing", "select * from orders")
def create_target_if_missing(t: Inputs):
    path = fresh_dir(t.spark, "made")
    name = "made_" + path.rsplit("-", 1)[1]
    sinks.create_target_if_missing(t.spark, name, t.orders.schema, path)
    sinks.create_target_if_missing(t.spark, name, t.orders.schema, path)
    t.orders.write.insertInto(name)
    return t.spark.table(name)


_DIRTY_CSV = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
        T.StructField("copy_no", T.IntegerType()),
    ]
)


@query(
    "scan_csv",
    """select c_custkey, copy_no, c_name || chr(10) || '"' || c_mktsegment as c_name, c_acctbal <> 'n/a' as readable,
         case when c_acctbal <> 'n/a' then cast(c_acctbal as double) end as c_acctbal from dirty""",
    ("dirty",),
)
def scan_csv(t: Inputs):
    """Texts with line breaks and quotes, numbers that are none."""
    path = fresh_dir(t.spark, "csv")
    name = F.concat("c_name", F.lit('\n"'), "c_mktsegment")
    sinks.export_csv(t.dirty.withColumn("c_name", name), path, t.dirty.columns)
    good, bad = tables.scan_csv(t.spark, path, _DIRTY_CSV)
    names = ["c_custkey", "copy_no", "c_name", "c_acctbal"]
    return good.select(*names, F.lit(True).alias("readable")).unionByName(bad.select(*names, F.lit(False).alias("readable")))


@query("write_lake", "select * from orders")
def write_lake(t: Inputs):
    path = fresh_dir(t.spark, "lake")
    sinks.write_lake(t.orders, path, ["o_orderpriority"])
    return t.spark.read.schema(t.orders.schema).parquet(path)


@query(
    "export_csv",
    """select cast(migration_id as string) as migration_id, status, coalesce(error_message, '') as error_message from jobs
       where contains(lower(job_name), '7')""",
    ("jobs",),
)
def export_csv(t: Inputs):
    path = fresh_dir(t.spark, "export")
    found = explore.search_any_column(t.jobs, "7", ["job_name"])
    sinks.export_csv(found, path, ["migration_id", "status", "error_message"], [F.col("migration_id").asc_nulls_last()])
    back = t.spark.read.option("header", True).schema("migration_id string, status string, error_message string").csv(path)
    return back.na.fill("")


@query(
    "export_json",
    """select audit_id, event_type, severity, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f') as occurred_at
       from audit order by occurred_at desc, audit_id desc limit 1000""",
    ("audit",),
)
def export_json(t: Inputs):
    path = fresh_dir(t.spark, "export")
    rows = t.audit.select("audit_id", "event_type", "severity", "occurred_at")
    sinks.export_json(rows, path, [F.col("occurred_at").desc(), F.col("audit_id").desc()], limit=1000)
    return t.spark.read.schema("audit_id bigint, event_type string, severity string, occurred_at string").json(path)


# ---- planning --------------------------------------------------------------

@query(
    "plan_chunks",
    f"""with n as ({_COUNTED}), s as (select *, least(100000, greatest(1000, row_count // 10)) as size from n),
         c as (select *, unnest(generate_series(0, greatest(1, cast(ceil(row_count / size) as bigint)) - 1)) as i from s)
       select '1-' || table_name || '-' || i as chunk_id, table_name, cast(i * size as bigint) as start_row,
         cast(case when row_count > 0 then least((i + 1) * size, row_count) - 1 else 0 end as bigint) as end_row,
         cast(case when row_count > 0 then least(size, row_count - i * size) else 0 end as bigint) as estimated_rows from c""",
)
def plan_chunks(t: Inputs):
    return chunks.plan_chunks(_row_counts(t), F.lit(1))


@query(
    "plan_chunks_fixed",
    f"""with n as ({_COUNTED}), c as (select *, unnest(range(0, row_count, 1000)) as row_offset from n)
       select '1#' || table_name || '#' || row_offset as chunk_id, table_name, cast(row_offset as bigint) as row_offset,
         cast(least(1000, row_count - row_offset) as bigint) as row_limit, row_count as total_rows from c""",
)
def plan_chunks_fixed(t: Inputs):
    return chunks.plan_chunks_fixed(_row_counts(t), F.lit(1), 1000)


@query("plan_key_ranges", "select o_orderkey, o_custkey, o_totalprice from orders")
def plan_key_ranges(t: Inputs):
    """All rows, read range by range: every row comes back once."""
    ranges = chunks.range_bounds(chunks.plan_key_ranges(t.orders, "o_orderkey", 8))
    return chunks.scan_ranges(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", ranges)


@query(
    "chunk_by_position",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, position, position // 1000 as chunk_no from (
         select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as position
         from lineitem)""",
)
def chunk_by_position(t: Inputs):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    placed = ordered.row_positions(t.lineitem.select(*order), order)
    return placed.withColumn("chunk_no", chunks.stride_chunk(F.col("position"), 1000))


@query(
    "chunk_id",
    """select l_orderkey, l_linenumber, '7#lineitem#' || (l_orderkey * 10) as offset_id, '7-lineitem-' || l_linenumber as ordinal_id
       from lineitem""",
)
def chunk_id(t: Inputs):
    table = F.lit("lineitem")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        text.offset_chunk_id(F.lit(7), table, F.col("l_orderkey") * 10).alias("offset_id"),
        text.ordinal_chunk_id(F.lit(7), table, F.col("l_linenumber")).alias("ordinal_id"),
    )


@query(
    "chunk_size_clamp",
    """select o_orderkey, least(100000, greatest(1000, cast(floor(o_orderkey * 100 / 10.0) as bigint))) as planned_rows,
         greatest(1, least(case when o_orderkey % 5 = 0 then 10000 else (o_orderkey - 100) * 10 end, 50000)) as fixed_rows from orders""",
)
def chunk_size_clamp(t: Inputs):
    asked = F.when(F.col("o_orderkey") % 10 == 0, F.lit(None)).when(F.col("o_orderkey") % 5 == 0, F.lit(0)).otherwise(
        (F.col("o_orderkey") - 100) * 10
    )
    return t.orders.select(
        "o_orderkey",
        numbers.planned_chunk_rows(F.col("o_orderkey") * 100).alias("planned_rows"),
        numbers.fixed_chunk_rows(asked).alias("fixed_rows"),
    )


@query(
    "chunk_count",
    """select migration_id, cast(ceil(total_rows / 700.0) as bigint) as chunks,
         cast(case when total_rows > 0 then ceil(total_rows / 700.0) else 1 end as bigint) as planner_chunks from jobs""",
    ("jobs",),
)
def chunk_count(t: Inputs):
    rows, size = F.col("total_rows"), F.lit(700)
    return t.jobs.select(
        "migration_id",
        numbers.chunk_count(rows, size).alias("chunks"),
        numbers.chunk_count(rows, size, when_empty=1).alias("planner_chunks"),
    )


@query(
    "pending_chunks",
    """select distinct migration_id, chunk_id from ledger
       where chunk_id not in (select chunk_id from ledger where status = 'COMPLETED')""",
    ("ledger",),
)
def pending_chunks(t: Inputs):
    from ferry.operators.ledger import current_ledger

    planned = t.ledger.where("status = 'PENDING'").select("migration_id", "chunk_id")
    return chunks.pending_chunks(planned, current_ledger(t.ledger))


# ---- copying ---------------------------------------------------------------

def _orders_plan() -> copy.CopyPlan:
    return copy.CopyPlan(migration_id=1, table="orders", key="o_orderkey", stride=1000)


@query(
    "copy_pending_chunks",
    """select *, '1#orders#' || ((o_orderkey // 1000) * 1000) as _chunk_id from orders where (o_orderkey // 1000) % 3 <> 0""",
)
def copy_pending_chunks(t: Inputs):
    root, plan = fresh_dir(t.spark, "copy"), _orders_plan()
    # Every third chunk was finished by an earlier run.
    finished = copy.chunks_of(t.orders.where("floor(o_orderkey / 1000) % 3 = 0"), plan).select(
        F.lit(1).cast("bigint").alias("migration_id"), "chunk_id", F.lit("orders").alias("table_name"),
        F.lit("COMPLETED").alias("status"), F.col("row_count").alias("rows_done"),
        F.lit(None).cast("string").alias("error"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("noted_at"),
    )
    finished.write.parquet(f"{root}/ledger")
    copy.copy_pending_chunks(t.spark, t.orders, root, plan, "run-2", "2024-01-02 00:00:00")
    copy.copy_pending_chunks(t.spark, t.orders, root, plan, "run-3", "2024-01-03 00:00:00")
    return copy.read_copy(t.spark, root)


@query(
    "copy_table",
    f"""{_CHECKED}, n as (select count(*) filter (where reasons = '' and c_custkey // 100 <> 1) as rows_copied, count(*) as total_rows,
         count(distinct c_custkey // 100) as chunks_total, count(distinct c_custkey // 100) filter (where c_custkey // 100 <> 1) as chunks_completed,
         count(distinct c_custkey // 100) filter (where c_custkey // 100 = 1) as chunks_failed from checked)
       select cast(1 as bigint) as migration_id, 'customer' as table_name, *, rows_copied * 100.0e0 / total_rows as progress_percent from n""",
    ("dirty",),
)
def copy_table(t: Inputs):
    """A source that cannot be read between keys 100 and 199, with rows to hold elsewhere."""
    plan = copy.CopyPlan(
        migration_id=1, table="customer", key="c_custkey", stride=100, order="copy_no",
        rules=(quality.not_null("c_name"), quality.one_of("c_nationkey", range(25)), quality.castable("c_acctbal", "double")),
    )
    broken = F.when(F.col("c_custkey").between(100, 199), F.raise_error(F.lit("unreadable page")).cast("string"))
    source = t.dirty.withColumn("c_mktsegment", broken.otherwise(F.col("c_mktsegment")))
    return copy.copy_table(t.spark, source, fresh_dir(t.spark, "copy"), plan, "2024-01-02 00:00:00")


@query("copy_composite_key", "select conv_id, turn, role, text from conversations")
def copy_composite_key(t: Inputs):
    """Chunks are ranges of (conv_id, turn); a second run finds the same ranges done."""
    root = fresh_dir(t.spark, "copy")
    plan = copy.CopyPlan(1, "conversations", "conv_id", 1, keys=("conv_id", "turn"))
    for run in ("run-1", "run-2"):
        ranged = copy.ranged_plan(t.spark, t.conversations, root, plan, 16)
        copy.copy_pending_chunks(t.spark, t.conversations, root, ranged, run, "2024-01-02 00:00:00")
    return copy.read_copy(t.spark, root).drop("_chunk_id")


@query(
    "copy_text_key",
    "select c_custkey, c_name, c_nationkey, c_acctbal, true as in_order from customer",
)
def copy_text_key(t: Inputs):
    """Customers by name. ``in_order``: no name lies in a chunk after a later name's chunk."""
    root = fresh_dir(t.spark, "copy")
    source = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    plan = copy.ranged_plan(t.spark, source, root, copy.CopyPlan(1, "customer", "c_name", 1), 12)
    copy.copy_pending_chunks(t.spark, source, root, plan, "run-1", "2024-01-02 00:00:00")
    rows = copy.read_copy(t.spark, root).withColumn("chunk_no", F.regexp_extract("_chunk_id", "[0-9]+$", 0).cast("bigint"))
    edges = rows.groupBy("chunk_no").agg(F.min("c_name").alias("least"), F.max("c_name").alias("most"))
    earlier = Window.orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    told = edges.select("chunk_no", F.coalesce(F.max("most").over(earlier) < F.col("least"), F.lit(True)).alias("in_order"))
    return rows.join(told, "chunk_no").drop("chunk_no", "_chunk_id")


@query("rollback_copied_rows", "select *, '1#orders#' || ((o_orderkey // 1000) * 1000) as _chunk_id from orders where (o_orderkey // 1000) % 2 = 0")
def rollback_copied_rows(t: Inputs):
    """Two runs, then the rows of the chunks that were complete after the first."""
    root, plan = fresh_dir(t.spark, "copy"), _orders_plan()
    copy.copy_pending_chunks(t.spark, t.orders.where("floor(o_orderkey / 1000) % 2 = 0"), root, plan, "run-1", "2024-01-01 00:00:00")
    ledger = copy.copy_pending_chunks(t.spark, t.orders, root, plan, "run-2", "2024-01-05 00:00:00")
    return copy.read_copy(t.spark, root, copy.finished_by(ledger, "2024-01-03 00:00:00"))


# ---- conversion ------------------------------------------------------------

@query(
    "convert_json",
    """select event_id, json_extract_string(props, '$.k') as k, event_id % 7 <> 0 as valid from events""",
)
def convert_json(t: Inputs):
    broken = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    out = t.events.select("event_id", broken.alias("raw")).withColumn("doc", convert.json_text(F.col("raw")))
    kept = F.col("doc") == F.col("raw")
    number = F.coalesce(F.get_json_object("doc", "$.k"), F.regexp_extract("doc", ": ([0-9]+)", 1))
    return out.select("event_id", number.alias("k"), (F.try_parse_json("doc").isNotNull() | ~kept).alias("valid"))


@query(
    "convert_datetime",
    """select event_id, case when date_part('microsecond', ts) % 1000000 = 0 then strftime(ts, '%Y-%m-%d %H:%M:%S')
           else strftime(ts, '%Y-%m-%d %H:%M:%S.%f') end as ts_text, strftime(ts, '%Y-%m-%d') as day_text,
         strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as second_text from events""",
)
def convert_datetime(t: Inputs):
    rows = t.events.select("event_id", "ts", F.col("ts").cast("date").alias("d"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("s"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(
        "event_id",
        convert.datetime_text(F.col("ts"), kinds["ts"]).alias("ts_text"),
        convert.datetime_text(F.col("d"), kinds["d"]).alias("day_text"),
        convert.datetime_text(F.col("s"), kinds["s"]).alias("second_text"),
    )


@query("convert_boolean", "select doc_id, quality <> 0 as quality, toxic <> 0 as toxic from labels")
def convert_boolean(t: Inputs):
    return convert.convert_columns(t.labels, {"quality": "boolean", "toxic": "boolean"}, "MYSQL", "POSTGRESQL")


@query(
    "map_type",
    """select migration_id, table_name, column_name, engine, source_type,
         case source_type when 'integer' then 'int' when 'decimal' then 'decimal' when 'varchar' then 'string' when 'blob' then 'binary'
           when 'timestamp' then 'timestamp_ntz' when 'bigint' then 'bigint' else upper(source_type) end as target_type
       from (select migration_id, table_name, column_name, case when migration_id % 2 = 0 then 'MYSQL' else 'POSTGRESQL' end as engine,
         case when column_name = 'photo' and migration_id % 3 = 0 then 'geometry' else column_type end as source_type from columns_after)""",
    ("columns_after",),
)
def map_type(t: Inputs):
    rows = t.columns_after.select(
        "migration_id", "table_name", "column_name",
        F.when(F.col("migration_id") % 2 == 0, "MYSQL").otherwise("POSTGRESQL").alias("engine"),
        F.when((F.col("column_name") == "photo") & (F.col("migration_id") % 3 == 0), "geometry").otherwise(F.col("column_type")).alias("source_type"),
    )
    return convert.map_types(rows, convert.type_mapping(t.spark))
