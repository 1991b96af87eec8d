"""Schema snapshots, drift between them, and DDL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ferry.functions.images import change_details

TABLE = ["migration_id", "table_name"]


def type_text(kind: Column, length: Column, precision: Column, scale: Column) -> Column:
    """``VARCHAR(50)``, ``DECIMAL(10,2)``, ``INTEGER``; a scale of 0 is kept."""
    upper = F.upper(kind)
    sized = kind.isin("varchar", "char") & length.isNotNull()
    exact = kind.isin("decimal", "numeric") & precision.isNotNull()
    digits = F.concat(upper, F.lit("("), precision.cast("string"), F.lit(","), F.coalesce(scale, F.lit(0)).cast("string"), F.lit(")"))
    return (
        F.when(sized, F.concat(upper, F.lit("("), length.cast("string"), F.lit(")"))).when(exact, digits).otherwise(upper)
    )


def typed(columns: DataFrame) -> DataFrame:
    return columns.withColumn(
        "type_text", type_text(F.col("column_type"), F.col("max_length"), F.col("num_precision"), F.col("num_scale"))
    )


def snapshot_documents(columns: DataFrame, indexes: DataFrame, source_type: str, captured_at: str) -> DataFrame:
    """One JSON definition per table under a named snapshot.

    The document is kept per table, not per database: a table's column list is
    short, a database's table list is not.
    """
    described = (
        typed(columns)
        .groupBy(*TABLE)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("ordinal", F.struct(F.col("column_name").alias("name"), F.col("type_text").alias("type"), "nullable", "primary_key").alias("c"))
                )
            ).alias("_columns")
        )
    )
    listed = indexes.groupBy(*TABLE).agg(F.sort_array(F.collect_list("index_name")).alias("_indexes"))
    stamp = F.date_format(F.lit(captured_at).cast("timestamp_ntz"), "yyyyMMdd_HHmmss")
    document = F.struct(
        F.transform("_columns", lambda c: c["c"]).alias("columns"),
        F.coalesce("_indexes", F.array().cast("array<string>")).alias("indexes"),
    )
    return described.join(listed, TABLE, "left").select(
        "migration_id",
        F.concat(F.lit(f"snapshot_{source_type.lower()}_"), stamp).alias("snapshot_name"),
        "table_name",
        F.to_json(document).alias("definition"),
    )


def read_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Column rows and index rows back from stored definitions."""
    from ferry.schemas import SNAPSHOT_TABLE

    parsed = documents.select(*TABLE, F.from_json("definition", SNAPSHOT_TABLE).alias("d"))
    columns = parsed.select(*TABLE, F.posexplode("d.columns").alias("ordinal", "c")).select(
        *TABLE, (F.col("ordinal") + 1).alias("ordinal"), F.col("c.name").alias("column_name"),
        F.col("c.type").alias("type_text"), F.col("c.nullable").alias("nullable"), F.col("c.primary_key").alias("primary_key"),
    )
    return columns, parsed.select(*TABLE, F.explode("d.indexes").alias("index_name"))


def _sides(before: DataFrame, after: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    """Keys of both sides with ``before``/``after`` marks and the values each side
    has for them. One shuffle with partial aggregation, no join."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        out = [F.lit(tag == t).alias(t) for t in ("before", "after")]
        for name, value in values.items():
            out += [(value if tag == t else F.lit(None).cast("string")).alias(f"{t}_{name}") for t in ("before", "after")]
        return df.select(*keys, *out)

    both = side(before, "before").unionByName(side(after, "after"))
    names = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in names])


def set_diff(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key with where it is: new (source only), removed (target only), common."""
    both = _sides(source, target, keys)
    place = F.when(~F.col("after"), "new").when(~F.col("before"), "removed").otherwise("common")
    return both.select(*keys, place.alias("place"))


def _event(change: Column, risk: Column, approval: Column, name: Column, details: Column) -> list[Column]:
    return [
        change.alias("change_type"),
        risk.alias("risk_level"),
        name.alias("object_name"),
        approval.alias("approval_required"),
        details.alias("change_details"),
    ]


def _table_event(new: Column) -> list[Column]:
    action = F.when(new, "table_added").otherwise("table_dropped")
    return _event(
        F.when(new, "CREATE_TABLE").otherwise("DROP_TABLE"),
        F.when(new, "MODERATE").otherwise("CRITICAL"),
        F.lit(True),
        F.lit(None).cast("string"),
        change_details(action, F.col("table_name")),
    )


def _column_event(status: Column, name: Column, before: Column, after: Column) -> list[Column]:
    added, altered = status == "ADDED", status == "ALTERED"
    details = change_details(
        F.concat(F.lit("column_"), F.lower(status)),
        F.col("table_name"),
        column=name,
        before_type=F.when(altered, before),
        after_type=F.when(altered, after),
    )
    return _event(
        F.when(added, "ADD_COLUMN").when(altered, "ALTER_TABLE").otherwise("DROP_COLUMN"),
        F.when(added, "MODERATE").otherwise("HIGH"),
        ~added,
        name,
        details,
    )


def _index_event(new: Column, name: Column) -> list[Column]:
    action = F.when(new, "index_added").otherwise("index_dropped")
    return _event(
        F.when(new, "CREATE_INDEX").otherwise("DROP_INDEX"),
        F.when(new, "SAFE").otherwise("MODERATE"),
        ~new,
        name,
        change_details(action, F.col("table_name"), index=name),
    )


def table_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables that came (CREATE_TABLE, MODERATE) or went (DROP_TABLE, CRITICAL);
    both need approval."""
    moved = set_diff(after, before, TABLE).where(F.col("place") != "common")
    return moved.select(*TABLE, *_table_event(F.col("place") == "new"))


def _type_status(strict: bool) -> Column:
    same = F.col("before_type").eqNullSafe(F.col("after_type"))
    if strict:
        same = same & F.col("before_nullable").eqNullSafe(F.col("after_nullable"))
    return F.when(~F.col("before"), "ADDED").when(~F.col("after"), "DROPPED").when(~same, "ALTERED").otherwise("SAME")


def diff_columns(before: DataFrame, after: DataFrame, strict: bool = False) -> DataFrame:
    """Columns of both sides matched by name: ADDED, DROPPED, ALTERED or SAME.
    Nullability counts only when ``strict``."""
    nullable = F.col("nullable").cast("string")
    both = _sides(before, after, [*TABLE, "column_name"], type=F.col("type_text"), nullable=nullable)
    return both.select(*TABLE, "column_name", "before_type", "after_type", _type_status(strict).alias("column_status"))


def _findings(columns: tuple[DataFrame, DataFrame], indexes: tuple[DataFrame, DataFrame] | None, strict: bool) -> DataFrame:
    """Columns and indexes of both snapshots, matched, with whether their table is
    in both.

    Everything is shuffled once, by table; matching by name and the look at the
    whole table then find their rows in place. A table's facts are as many as its
    columns and indexes.
    """

    def facts(df: DataFrame, kind: str, name: str, tag: str, shape: Column, nullable: Column) -> DataFrame:
        return df.select(
            *TABLE, F.lit(kind).alias("kind"), F.col(name).alias("name"),
            F.lit(tag == "before").alias("before"), F.lit(tag == "after").alias("after"),
            shape.alias("type_text"), nullable.cast("string").alias("nullable"),
        )

    none, listed = F.lit(""), None
    for i, tag in enumerate(("before", "after")):
        parts = [facts(columns[i], "column", "column_name", tag, F.col("type_text"), F.col("nullable"))]
        if indexes:
            parts.append(facts(indexes[i], "index", "index_name", tag, none, none))
        for part in parts:
            listed = part if listed is None else listed.unionByName(part)
    sided = [
        F.max(F.when(F.col(tag), F.col(value))).alias(f"{tag}_{name}")
        for tag in ("before", "after") for name, value in (("type", "type_text"), ("nullable", "nullable"))
    ]
    matched = listed.repartition(*TABLE).groupBy(*TABLE, "kind", "name").agg(
        F.max("before").alias("before"), F.max("after").alias("after"), *sided
    )
    whole = Window.partitionBy(*TABLE)
    is_column = F.col("kind") == "column"
    return (
        matched.withColumn("table_before", F.max(is_column & F.col("before")).over(whole))
        .withColumn("table_after", F.max(is_column & F.col("after")).over(whole))
        .withColumn("place", F.row_number().over(whole.orderBy("kind", "name")))
        .withColumn("column_status", _type_status(strict))
    )




def _in_both() -> Column:
    return F.col("table_before") & F.col("table_after")


def column_drift(before: DataFrame, after: DataFrame, strict: bool = False) -> DataFrame:
    """Column changes of tables both snapshots have."""
    found = _findings((before, after), None, strict).where(_in_both() & (F.col("column_status") != "SAME"))
    return found.select(*TABLE, *_column_event(*[F.col(c) for c in ("column_status", "name", "before_type", "after_type")]))


def index_drift(before: DataFrame, after: DataFrame, tables_before: DataFrame, tables_after: DataFrame) -> DataFrame:
    """Index changes of tables both snapshots have: added is SAFE, dropped MODERATE."""
    found = _findings((typed(tables_before), typed(tables_after)), (before, after), False)
    moved = found.where(_in_both() & (F.col("kind") == "index") & (F.col("before") != F.col("after")))
    return moved.select(*TABLE, *_index_event(F.col("after"), F.col("name")))


def drift_between(before: DataFrame, after: DataFrame, indexes_before: DataFrame, indexes_after: DataFrame, strict: bool = False) -> DataFrame:
    """Table, column and index findings in one list, from one pass over both
    snapshots. A table that came or went is told once and its parts are not."""
    found = _findings((before, after), (indexes_before, indexes_after), strict)
    status, name = F.col("column_status"), F.col("name")
    is_column = F.col("kind") == "column"
    events = F.array_compact(
        F.array(
            F.when(~_in_both() & (F.col("place") == 1) & (F.col("table_before") | F.col("table_after")), F.struct(*_table_event(F.col("table_after")))),
            F.when(
                _in_both() & is_column & (status != "SAME"),
                F.struct(*_column_event(status, name, F.col("before_type"), F.col("after_type"))),
            ),
            F.when(_in_both() & ~is_column & (F.col("before") != F.col("after")), F.struct(*_index_event(F.col("after"), name))),
        )
    )
    return found.select(*TABLE, F.inline(events))


def compare_schemas(
    source: DataFrame, target: DataFrame, source_indexes: DataFrame, target_indexes: DataFrame,
    source_fks: DataFrame, target_fks: DataFrame, strict: bool = False,
) -> DataFrame:
    """Per table that differs: NEW, REMOVED or MODIFIED with the sorted names that
    differ, as comma lists. All facts are shuffled once, by table."""

    def facts(df: DataFrame, side: str, kind: str, name: Column, shape: Column) -> DataFrame:
        return df.select(*TABLE, F.lit(side).alias("side"), F.lit(kind).alias("kind"), name.alias("name"), shape.alias("shape"))

    keys = ["column_type", "nullable", "max_length"] + (["num_precision", "num_scale"] if strict else [])
    shape = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])
    none = F.lit("")
    listed = None
    for side, columns, indexes, fks in (("s", source, source_indexes, source_fks), ("t", target, target_indexes, target_fks)):
        for part in (
            facts(columns, side, "column", F.col("column_name"), shape),
            facts(indexes, side, "index", F.col("index_name"), none),
            facts(fks, side, "foreign_key", F.col("constraint_name"), none),
        ):
            listed = part if listed is None else listed.unionByName(part)
    matched = listed.repartition(*TABLE).groupBy(*TABLE, "kind", "name").agg(
        F.max(F.when(F.col("side") == "s", F.col("shape"))).alias("s"),
        F.max(F.when(F.col("side") == "t", F.col("shape"))).alias("t"),
    )
    is_column = F.col("kind") == "column"
    how = F.when(F.col("t").isNull(), "new").when(F.col("s").isNull(), "removed").when(F.col("s") != F.col("t"), "modified")
    per_table = matched.withColumn("how", how).groupBy(*TABLE).agg(
        F.max(is_column & F.col("s").isNotNull()).alias("_s"),
        F.max(is_column & F.col("t").isNotNull()).alias("_t"),
        F.sort_array(F.collect_list(F.when(F.col("how").isNotNull(), F.struct("name", "kind", "how")))).alias("_differ"),
    )

    def names(how_: str, kind: str) -> Column:
        picked = F.filter("_differ", lambda d: (d["how"] == how_) & (d["kind"] == kind))
        return F.array_join(F.transform(picked, lambda d: d["name"]), ",")

    lists = {
        "new_columns": ("new", "column"),
        "removed_columns": ("removed", "column"),
        "modified_columns": ("modified", "column"),
        "new_indexes": ("new", "index"),
        "removed_indexes": ("removed", "index"),
        "new_foreign_keys": ("new", "foreign_key"),
        "removed_foreign_keys": ("removed", "foreign_key"),
    }
    status = F.when(~F.col("_t"), "NEW").when(~F.col("_s"), "REMOVED").otherwise("MODIFIED")
    whole = F.col("table_status") != "MODIFIED"
    return (
        per_table.withColumn("table_status", status)
        .where(whole | (F.size("_differ") > 0))
        .select(*TABLE, "table_status", *[F.when(whole, "").otherwise(names(*v)).alias(n) for n, v in lists.items()])
    )


def foreign_key_map(constraints: DataFrame, key_columns: DataFrame, referenced: DataFrame) -> DataFrame:
    """Constraint → column → referenced table and column. A constraint is told by
    database, table and name (names repeat between tables), and the n-th column of
    a key refers to the n-th referenced one: both sides carry ``ordinal``."""
    names = ["migration_id", "table_name", "constraint_name"]
    fks = constraints.where(F.col("constraint_type") == "FOREIGN KEY").select(*names)
    return (
        fks.join(key_columns.select(*names, "ordinal", "column_name"), names)
        .join(referenced.select(*names, "ordinal", "referenced_table", "referenced_column"), [*names, "ordinal"])
        .select(*names, "column_name", "referenced_table", "referenced_column")
    )


def with_primary_keys(columns: DataFrame, constraints: DataFrame, key_columns: DataFrame) -> DataFrame:
    """Column rows with ``primary_key`` taken from the key lists, for catalogs
    whose column list does not tell."""
    names = ["migration_id", "table_name", "constraint_name"]
    keys = (
        constraints.where(F.col("constraint_type") == "PRIMARY KEY")
        .select(*names)
        .join(key_columns.select(*names, "column_name"), names)
        .select(*TABLE, "column_name", F.lit(True).alias("_key"))
        .distinct()
    )
    marked = columns.drop("primary_key").join(keys, [*TABLE, "column_name"], "left")
    return marked.withColumn("primary_key", F.coalesce("_key", F.lit(False))).drop("_key")


# Opening and closing quotes, and the words for a column that counts by itself.
_QUOTES = {"MYSQL": ("`", "`"), "POSTGRESQL": ('"', '"'), "SQL_SERVER": ("[", "]"), "ORACLE": ('"', '"')}
_COUNTERS = {"MYSQL": " AUTO_INCREMENT", "SQL_SERVER": " IDENTITY(1,1)"}


def create_table_ddl(columns: DataFrame, engine: str = "MYSQL") -> DataFrame:
    """CREATE TABLE text per table, columns in order. One key column is marked in
    line, several are listed at the end."""
    left, right = _QUOTES[engine]
    quoted = lambda c: F.concat(F.lit(left), F.replace(F.col(c), F.lit(right), F.lit(2 * right)), F.lit(right))
    name = quoted("column_name")
    kind = F.col("column_type")
    precision, length = F.col("num_precision"), F.col("max_length")
    size = (
        F.when(kind.isin("varchar", "char") & length.isNotNull(), F.concat(F.lit("("), length.cast("string"), F.lit(")")))
        .when(
            kind.isin("decimal", "numeric") & precision.isNotNull(),
            F.concat(F.lit("("), precision.cast("string"), F.lit(","), F.coalesce("num_scale", F.lit(0)).cast("string"), F.lit(")")),
        )
        .otherwise("")
    )
    counter = F.when(F.col("auto_increment"), _COUNTERS.get(engine, " GENERATED BY DEFAULT AS IDENTITY")).otherwise("")
    required = F.when(F.col("nullable"), "").otherwise(" NOT NULL")
    default = F.coalesce(F.concat(F.lit(" DEFAULT "), F.col("column_default")), F.lit(""))
    # Oracle takes what fills a column only before its constraints.
    rest = [default, counter, required] if engine == "ORACLE" else [required, default, counter]
    definition = F.concat(F.lit("    "), name, F.lit(" "), kind, size, *rest)
    parts = columns.select(*TABLE, F.struct("ordinal", definition.alias("d"), name.alias("n"), F.col("primary_key").alias("pk")).alias("c"))
    listed = parts.groupBy(*TABLE).agg(F.sort_array(F.collect_list("c")).alias("cs"))
    keys = F.transform(F.filter("cs", lambda c: c["pk"]), lambda c: c["n"])
    single = F.size(keys) == 1
    lines = F.transform("cs", lambda c: F.concat(c["d"], F.when(single & c["pk"], F.lit(" PRIMARY KEY")).otherwise("")))
    tail = F.when(F.size(keys) > 1, F.concat(F.lit(",\n    PRIMARY KEY ("), F.array_join(keys, ", "), F.lit(")"))).otherwise("")
    text = F.concat(
        F.lit("CREATE TABLE "), quoted("table_name"), F.lit(" (\n"), F.array_join(lines, ",\n"), tail, F.lit("\n)")
    )
    return listed.select(*TABLE, text.alias("ddl"))
