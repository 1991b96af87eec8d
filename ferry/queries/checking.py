"""Verification, quality rules, masking and small column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ferry.functions import images, masking, numbers, text
from ferry.inputs import GIVEN, Inputs
from ferry.operators import mask, quality, verify
from ferry.queries.registry import query
from ferry.schemas import JOB_STATUSES

_COUNTS = " union all ".join(f"select '{n}' as table_name, count(*) as {{0}} from {n}" for n in GIVEN)


@query("table_row_counts", _COUNTS.format("row_count"))
def table_row_counts(t: Inputs):
    return verify.table_row_counts({n: getattr(t, n) for n in GIVEN})


@query("approx_row_counts", _COUNTS.format("estimated_rows") + " union all select 'not_there', null")
def approx_row_counts(t: Inputs):
    return verify.approx_row_counts(t.spark, {**{n: getattr(t, n) for n in GIVEN}, "not_there": None})


@query(
    "compare_row_counts",
    """with s as (select cast(floor(o_orderkey / 1000) as bigint) as chunk_no, count(*) as n from source_orders group by 1),
         d as (select cast(floor(o_orderkey / 1000) as bigint) as chunk_no, count(*) as n from target_orders group by 1)
       select chunk_no, coalesce(s.n, 0) as source_rows, coalesce(d.n, 0) as target_rows, coalesce(s.n, 0) <> coalesce(d.n, 0) as mismatch,
         coalesce(s.n, 0) = coalesce(d.n, 0) as verified from s full join d using (chunk_no)""",
    ("source_orders", "target_orders"),
)
def compare_row_counts(t: Inputs):
    chunk = F.floor(F.col("o_orderkey") / 1000).cast("bigint")
    side = lambda df: df.select(chunk.alias("chunk_no"))
    return verify.compare_row_counts(side(t.source_orders), side(t.target_orders), ["chunk_no"])


def _exact_sql(x: str) -> str:
    """A double's value by its bits: whole part, then 53 bits of the fraction at a time."""
    whole, bits = f"floor(abs({x}))", "9007199254740992.0e0"
    first = f"((abs({x}) - {whole}) * {bits})"
    rest = f"(({first} - floor({first})) * {bits})"
    number = lambda v: f"cast(cast(floor({v}) as bigint) as varchar)"
    return (
        f"(case when {x} < 0 then '-' else '' end || {number(f'abs({x})')} || '.' || {number(first)}"
        f" || case when {rest} = 0 then '' else '.' || {number(rest)} end)"
    )


def _text_sql(columns: dict[str, str]) -> str:
    parts = []
    for name, kind in columns.items():
        spelled = {
            "double": _exact_sql(name),
            "time": f"cast(epoch_us({name}) as varchar)",
            "text": f"length({name}) || ':' || {name}",
            "floats": f"len({name}) || '[' || array_to_string(list_transform({name}, lambda x: coalesce({_exact_sql('cast(x as double)')}, '-')), '|') || ']'",
        }.get(kind, f"cast({name} as varchar)")
        parts.append(f"coalesce({spelled}, '-')")
    return " || '|' || ".join(parts)


# Columns of the given tables with what their text needs; the others are whole numbers.
_KINDS = {
    "region": "r_regionkey r_name:text",
    "nation": "n_nationkey n_name:text n_regionkey",
    "customer": "c_custkey c_name:text c_nationkey c_acctbal:double c_mktsegment:text",
    "supplier": "s_suppkey s_name:text s_nationkey s_acctbal:double",
    "part": "p_partkey p_name:text p_brand:text p_type:text p_size p_retailprice:double",
    "orders": "o_orderkey o_custkey o_orderstatus:text o_totalprice:double o_orderdate:time o_orderpriority:text",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:double l_extendedprice:double l_discount:double l_tax:double"
    " l_returnflag:text l_linestatus:text l_shipdate:time",
    "events": "event_id ts:time user_id event_type:text value:double props:text",
    "documents": "doc_id text:text lang:text source:text n_chars",
    "embeddings": "vec_id embedding:floats label",
    "pages": "page_id url:text html:text",
    "benchmark": "item_id text:text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role:text text:text",
}
_COLUMNS = {table: dict((c.split(":") + [""])[:2] for c in text.split()) for table, text in _KINDS.items()}
_ORDERS, _LINES = _COLUMNS["orders"], _COLUMNS["lineitem"]
_SUM = " || '-' || ".join(f"cast(cast(sum(cast('0x' || substr(md5({{0}}), {k}, 8) as bigint)) as hugeint) as varchar)" for k in (1, 9, 17, 25))


_WHOLE = " union all ".join(
    f"select '{n}' as table_name, 'all' as part, count(*) as row_count, {_SUM.format(_text_sql(columns))} as checksum from {n}"
    for n, columns in _COLUMNS.items()
)


@query(
    "table_checksum",
    f"""{_WHOLE}
        union all select 'source', cast(o_orderkey // 1000 as varchar), count(*), {_SUM.format(_text_sql(_ORDERS))} from source_orders group by o_orderkey // 1000
        union all select 'target', cast(o_orderkey // 1000 as varchar), count(*), {_SUM.format(_text_sql(_ORDERS))} from target_orders group by o_orderkey // 1000""",
    ("source_orders", "target_orders"),
)
def table_checksum(t: Inputs):
    """All given tables as a whole, and two tables chunk by chunk."""
    parts = [(n, verify.table_checksum(getattr(t, n)).withColumn("part", F.lit("all"))) for n in GIVEN]
    for name, df in (("source", t.source_orders), ("target", t.target_orders)):
        part = F.floor(F.col("o_orderkey") / 1000).cast("bigint").cast("string").alias("part")
        parts.append((name, verify.table_checksum(df.select("*", part), ["part"], df.columns)))
    rows = [df.select(F.lit(n).alias("table_name"), "part", "row_count", "checksum") for n, df in parts]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(
    "diff_tables",
    """select o_orderkey, case when d.o_custkey is null then 'MISSING_IN_TARGET' when s.o_custkey is null then 'EXTRA_IN_TARGET'
           when s.o_totalprice <> d.o_totalprice then 'CHANGED' else 'MATCH' end as diff_status,
         case when s.o_totalprice <> d.o_totalprice then 'o_totalprice' else '' end as changed_columns
       from source_orders s full join target_orders d using (o_orderkey)""",
    ("source_orders", "target_orders"),
)
def diff_tables(t: Inputs):
    return verify.diff_tables(t.source_orders, t.target_orders, ["o_orderkey"])


@query(
    "diff_keyless",
    f"""with s as (select md5({_text_sql(_LINES)}) as row_hash, count(*) as n from lineitem group by 1),
         d as (select md5({_text_sql(_LINES)}) as row_hash, count(*) as n from (select * from lineitem where l_orderkey % 50 <> 0
           union all select * from lineitem where l_orderkey % 77 = 0) group by 1)
       select row_hash, coalesce(s.n, 0) as source_copies, coalesce(d.n, 0) as target_copies from s full join d using (row_hash)
       where coalesce(s.n, 0) <> coalesce(d.n, 0)""",
)
def diff_keyless(t: Inputs):
    lines = t.lineitem
    changed = lines.where("l_orderkey % 50 <> 0").unionByName(lines.where("l_orderkey % 77 = 0"))
    return verify.diff_keyless(lines, changed)


def _bytes_sql(name: str, width: int, *texts: str, arrays: str = "0") -> str:
    longs = " + ".join([f"coalesce(sum(octet_length(encode({c}))), 0)" for c in texts] + [arrays])
    return (
        f"select '{name}' as table_name, count(*) as row_count, cast(count(*) * {width} + {longs} as bigint) as estimated_bytes,"
        f" cast(ceil(count(*) / 5000.0) as bigint) as estimated_seconds from {name}"
    )


@query(
    "size_estimate",
    " union all ".join(
        (
            _bytes_sql("region", 4, "r_name"),
            _bytes_sql("nation", 8, "n_name"),
            _bytes_sql("customer", 20, "c_name", "c_mktsegment"),
            _bytes_sql("supplier", 20, "s_name"),
            _bytes_sql("part", 20, "p_name", "p_brand", "p_type"),
            _bytes_sql("orders", 32, "o_orderstatus", "o_orderpriority"),
            _bytes_sql("lineitem", 68, "l_returnflag", "l_linestatus"),
            _bytes_sql("events", 32, "event_type", "props"),
            _bytes_sql("documents", 16, "text", "lang", "source"),
            _bytes_sql("embeddings", 12, arrays="coalesce(sum(len(embedding) * 4), 0)"),
            _bytes_sql("pages", 8, "url", "html"),
            _bytes_sql("benchmark", 8, "text"),
            _bytes_sql("labels", 16),
            _bytes_sql("conversations", 16, "role", "text"),
        )
    ),
)
def size_estimate(t: Inputs):
    return verify.size_estimate({n: getattr(t, n) for n in GIVEN}, 5000)


@query("referential_violations", "select * from dirty where c_nationkey is not null and c_nationkey not in (select n_nationkey from nation)", ("dirty",))
def referential_violations(t: Inputs):
    return quality.referential_violations(t.dirty, "c_nationkey", t.nation, "n_nationkey")


_TURNS = "select conv_id, turn, case when turn > 0 then turn - 1 end as previous, role from conversations"


@query(
    "referential_violations_composite",
    f"""select * from ({_TURNS}) c where conv_id is not null and previous is not null
          and not exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn = c.previous and p.role <> 'user')""",
)
def referential_violations_composite(t: Inputs):
    """Turns whose turn before is missing or the user's; first turns refer to none."""
    turns = t.conversations.select("conv_id", "turn", F.when(F.col("turn") > 0, F.col("turn") - 1).alias("previous"), "role")
    others = t.conversations.where(F.col("role") != "user")
    return quality.referential_violations(turns, ["conv_id", "previous"], others, ["conv_id", "turn"])


@query(
    "referential_violations_full",
    f"""select * from ({_TURNS}) c where (conv_id is not null and previous is null) or (conv_id is null and previous is not null)
          or (conv_id is not null and previous is not null
            and not exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn = c.previous and p.role <> 'assistant'))""",
)
def referential_violations_full(t: Inputs):
    """MATCH FULL against the turns that are not the assistant's: a key null in part is told."""
    turns = t.conversations.select("conv_id", "turn", F.when(F.col("turn") > 0, F.col("turn") - 1).alias("previous"), "role")
    others = t.conversations.where(F.col("role") != "assistant")
    return quality.referential_violations(turns, ["conv_id", "previous"], others, ["conv_id", "turn"], full=True)


# ---- masking ---------------------------------------------------------------

_EMAIL = (
    "case when email is null then 'NULL' else case when length(split_part(email, '@', 1)) <= 1 then '' else substr(email, 1, 1) end"
    " || '***@' || split_part(email, '@', 2) end"
)
_PHONE = "case when phone is null then 'NULL' else substr(phone, 1, 2) || repeat('*', length(phone) - 4) || substr(phone, length(phone) - 1) end"


@query(
    "mask_table",
    f"""select c_custkey, first_name, {_EMAIL} as email, {_PHONE} as phone,
          case when salary is null then 'NULL' else '*****' end as salary,
          case when password is null then 'NULL' else '********' end as password, department from people""",
    ("people",),
)
def mask_table(t: Inputs):
    return mask.mask_table(t.people)


_MIXED = (
    "case c_custkey % 5 when 0 then email when 1 then phone when 2 then cast(c_custkey as string)"
    " when 3 then concat('a', substr(email, strpos(email, '@'))) else department end"
)


@query(
    "mask_value",
    f"""with v as (select c_custkey, {_MIXED} as v, email, phone from people),
         m as (select *, regexp_matches(v, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') as is_mail, regexp_matches(v, '^[0-9+\\-\\s()]{{7,20}}$') as is_phone,
           case when v like '%@%' then case when length(split_part(v, '@', 1)) <= 1 then '' else substr(v, 1, 1) end || '***@' || split_part(v, '@', 2) end as mail from v)
       select c_custkey,
         case when v is null then 'NULL' else '********' end as api_token,
         case when v is null then 'NULL' when is_mail then mail else '********' end as home_address,
         case when v is null then 'NULL' when is_mail then mail when is_phone then substr(v, 1, 2) || repeat('*', length(v) - 4) || substr(v, length(v) - 1) else '********' end as contact,
         case when v is null then 'NULL' when is_mail then mail else '*****' end as credit_limit from m""",
    ("people",),
)
def mask_value(t: Inputs):
    mixed = t.people.select("c_custkey", F.expr(_MIXED.replace("strpos(email, '@')", "instr(email, '@')")).alias("v"))
    names = ("api_token", "home_address", "contact", "credit_limit")
    return mixed.select("c_custkey", *[masking.mask_value(n, F.col("v")).alias(n) for n in names])


@query("mask_email", f"select c_custkey, case when email is not null then {_EMAIL} end as email, case when email is not null then '***@example.com' end as short_email from people", ("people",))
def mask_email(t: Inputs):
    short = F.concat(F.lit("x"), F.substring_index("email", "@", -1))
    short = F.concat(F.substring(short, 1, 1), F.lit("@"), F.substring_index("email", "@", -1))
    return t.people.select("c_custkey", masking.mask_email(F.col("email")).alias("email"), masking.mask_email(short).alias("short_email"))


@query(
    "mask_phone",
    f"""select c_custkey, case when phone is not null then {_PHONE} end as phone, case when phone is not null then substr(phone, 1, 2) || repeat('*', 6) || substr(phone, length(phone) - 1) end as spaced,
          repeat('*', length(cast(c_custkey % 10000 as varchar))) as short from people""",
    ("people",),
)
def mask_phone(t: Inputs):
    phone = F.col("phone")
    spaced = F.concat(F.lit("("), F.substring(phone, 1, 3), F.lit(") "), F.substring(phone, 4, 3), F.lit("-"), F.substring(phone, 7, 4))
    return t.people.select(
        "c_custkey",
        masking.mask_phone(phone).alias("phone"),
        masking.mask_phone(spaced).alias("spaced"),
        masking.mask_phone((F.col("c_custkey") % 10000).cast("string")).alias("short"),
    )


@query("drop_binary_columns", "select c_custkey, c_name, c_mktsegment from customer")
def drop_binary_columns(t: Inputs):
    rows = t.customer.select("c_custkey", "c_name", F.col("c_name").cast("binary").alias("photo"), "c_mktsegment", "c_acctbal")
    raw = F.col("c_acctbal").alias("c_acctbal", metadata={"source_type": " Long RAW "})
    return mask.drop_binary_columns(rows.withColumn("c_acctbal", raw))


@query("masked_columns", "select distinct migration_id, table_name, column_name from columns_after where column_name = 'user_email'", ("columns_after",))
def masked_columns(t: Inputs):
    return mask.masked_columns(t.columns_after, ("migration_id", "table_name"))


_NAMES = "concat(p_brand, case p_partkey % 8 when 0 then '-Api Key' when 1 then ' E-Mail' when 2 then ' Company' when 3 then ' Unit Price' when 4 then '-Pass Word' when 5 then ' Card No' else concat(' ', p_name) end)"


@query("normalise_name", f"select p_partkey, lower(translate({_NAMES}, '- ', '__')) as plain_name from part")
def normalise_name(t: Inputs):
    return t.part.select("p_partkey", text.normalise_name(F.expr(_NAMES)).alias("plain_name"))


@query("is_sensitive_name", f"select p_partkey, {_NAMES} as name, p_partkey % 8 in (0, 2, 5) as sensitive from part")
def is_sensitive_name(t: Inputs):
    rows = t.part.select("p_partkey", F.expr(_NAMES).alias("name"))
    return rows.withColumn("sensitive", masking.is_sensitive_name(F.col("name")))


@query("check_identifier", f"select p_partkey, regexp_matches(replace({_NAMES}, '#', '$'), '^[A-Za-z0-9_$]+$') as safe, regexp_matches(p_brand, '^[A-Za-z0-9_$]+$') as brand_safe from part")
def check_identifier(t: Inputs):
    return t.part.select(
        "p_partkey",
        text.is_safe_identifier(F.replace(F.expr(_NAMES), F.lit("#"), F.lit("$"))).alias("safe"),
        text.is_safe_identifier(F.col("p_brand")).alias("brand_safe"),
    )


# ---- small functions -------------------------------------------------------

@query(
    "lsn_order",
    """select event_id, lsn, cast('0x' || split_part(lsn, '/', 1) as bigint) * 4294967296 + cast('0x' || split_part(lsn, '/', 2) as bigint) as lsn_number,
         cast((1764594785 + event_id)::hugeint * 4294967296 + event_id as varchar) as decimal_number,
         cast(cast('0x1764594785' as bigint)::hugeint * 4294967296 + event_id as varchar) as long_number from change_events""",
    ("change_events",),
)
def lsn_order(t: Inputs):
    """Positions in base 16, in base 10, and with a half of more than 32 bits."""
    number = F.col("event_id")
    in_decimal = F.concat((number + 1764594785).cast("string"), F.lit("/"), number.cast("string"))
    return t.change_events.select(
        "event_id",
        "lsn",
        numbers.lsn_number(F.col("lsn")).cast("bigint").alias("lsn_number"),
        numbers.lsn_number(in_decimal, 10).cast("string").alias("decimal_number"),
        numbers.lsn_number(F.concat(F.lit("1764594785/"), F.hex(number))).cast("string").alias("long_number"),
    )


@query(
    "classify_error",
    """select event_id, case when contains(message, '10060') or contains(message, '2003') or contains(lower(message), 'timed out') then 'TIMEOUT'
         when contains(message, '1045') or contains(lower(message), 'access denied') then 'AUTH'
         when contains(message, '1049') or contains(lower(message), 'unknown database') then 'NO_DATABASE' else 'OTHER' end as error_class from error_log""",
    ("error_log",),
)
def classify_error(t: Inputs):
    return t.error_log.select("event_id", text.classify_error(F.col("message")).alias("error_class"))


@query(
    "progress_percent",
    """select migration_id, case when total_rows > 0 then least(rows_migrated * 2 * 100.0e0 / total_rows, 100.0e0) else 100.0e0 end as copy_percent,
         case when total_rows > 0 then least(rows_migrated * 100.0e0 / total_rows, 100.0e0) else 0.0e0 end as chunk_percent from jobs""",
    ("jobs",),
)
def progress_percent(t: Inputs):
    return t.jobs.select(
        "migration_id",
        numbers.progress_percent(F.col("rows_migrated") * 2, F.col("total_rows")).alias("copy_percent"),
        numbers.progress_percent(F.col("rows_migrated"), F.col("total_rows"), when_empty=0.0).alias("chunk_percent"),
    )


@query(
    "encode_image",
    """select event_id, case when event_id % 9 <> 0 then '{"id":' || user_id || ',"kind":"' || event_type || '"}' end as image from events""",
)
def encode_image(t: Inputs):
    present = F.col("event_id") % 9 != 0
    image = images.encode_image(F.when(present, F.col("user_id")).alias("id"), F.when(present, F.col("event_type")).alias("kind"))
    return t.events.select("event_id", image.alias("image"))


@query(
    "decode_image",
    """select event_id, cast(json_extract_string(after_data, '$.id') as bigint) as id, cast(json_extract_string(after_data, '$.value') as double) as value,
         cast(json_extract_string(after_data, '$.k') as int) as k from change_events""",
    ("change_events",),
)
def decode_image(t: Inputs):
    return t.change_events.select("event_id", images.decode_image(F.col("after_data"), "id bigint, value double, k int").alias("i")).select(
        "event_id", "i.id", "i.value", "i.k"
    )


@query(
    "json_array_contains",
    """select config_id, subscribed_events = '[]' or contains(subscribed_events, '"MIGRATION_FAILED"') as wants_failures,
         subscribed_events = '[]' or contains(subscribed_events, '"LAMBDA_FAILED"') as wants_lambda from subscriptions""",
    ("subscriptions",),
)
def json_array_contains(t: Inputs):
    listed = F.col("subscribed_events")
    return t.subscriptions.select(
        "config_id",
        images.list_allows(listed, F.lit("MIGRATION_FAILED")).alias("wants_failures"),
        images.list_allows(listed, F.lit("LAMBDA_FAILED")).alias("wants_lambda"),
    )


_MESSY = "case migration_id % 4 when 0 then concat('  ', lower(status), ' ') when 1 then concat(status, ' ') when 2 then concat(status, '_X') else status end"


@query(
    "normalise_enum",
    f"select migration_id, upper(trim({_MESSY})) as status, migration_id % 4 <> 2 as accepted from jobs",
    ("jobs",),
)
def normalise_enum(t: Inputs):
    raw = F.expr(_MESSY)
    return t.jobs.select("migration_id", text.normalise_enum(raw).alias("status"), text.in_enum(raw, JOB_STATUSES).alias("accepted"))


@query(
    "change_details",
    """select migration_id, table_name, column_name, '{"action":"column_altered","table":"' || table_name || '","column":"' || column_name || '"'
         || case when max_length is not null then ',"before_type":"' || column_type || '"' else '' end || ',"after_type":"text"}' as change_details
       from columns_after""",
    ("columns_after",),
)
def change_details(t: Inputs):
    details = images.change_details(
        F.lit("column_altered"), F.col("table_name"), column=F.col("column_name"),
        before_type=F.when(F.col("max_length").isNotNull(), F.col("column_type")), after_type=F.lit("text"),
    )
    return t.columns_after.select("migration_id", "table_name", "column_name", details.alias("change_details"))
