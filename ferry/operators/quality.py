"""Row checks that split a table into loadable and quarantined rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F


def not_null(column: str) -> tuple[str, Column]:
    return f"{column} is null", F.col(column).isNotNull()


def castable(column: str, data_type: str) -> tuple[str, Column]:
    value = F.col(column)
    return f"{column} is not {data_type}", value.isNull() | value.try_cast(data_type).isNotNull()


def max_length(column: str, chars: int) -> tuple[str, Column]:
    value = F.col(column)
    return f"{column} is longer than {chars}", value.isNull() | (F.length(value) <= chars)


def one_of(column: str, allowed: Sequence) -> tuple[str, Column]:
    value = F.col(column)
    return f"{column} is not allowed", value.isNull() | value.isin(*allowed)


def check_rows(df: DataFrame, rules: Sequence[tuple[str, Column]], key: str | None = None, order: str | None = None) -> DataFrame:
    """Add ``reasons``: the names of the rules a row breaks, in rule order.

    With a key, only rows that keep every rule compete for it: the first of them by
    ``order`` stays, the others break ``duplicate key``. Where two tie for the first
    place, or no row of a repeated key has an order, all of these break ``ambiguous
    copy``: nothing says which one to load. Rows are counted by (key, order) first and
    only keys that do repeat take part in the join, so a hot key is not gathered in
    one task.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]).cast("array<string>"))
    checked = df.withColumn("reasons", broken)
    if not key:
        return checked
    fit = (F.size("reasons") == 0) & F.col(key).isNotNull()
    repeated = (
        checked.where(fit)
        .groupBy(key, F.col(order).alias("_order"))
        .agg(F.count(F.lit(1)).alias("_ties"))
        .groupBy(key)
        .agg(F.sum("_ties").alias("_copies"), F.min("_order").alias("_first"), F.min_by("_ties", "_order").alias("_ties"))
        .where(F.col("_copies") > 1)
    )
    competes = (F.size("reasons") == 0) & F.col("_copies").isNotNull()
    later = F.col("_first").isNotNull() & (F.col(order).isNull() | (F.col(order) > F.col("_first")))
    reason = F.when(later, F.array(F.lit("duplicate key"))).when(
        F.col("_first").isNull() | (F.col("_ties") > 1), F.array(F.lit("ambiguous copy"))
    )
    told = F.when(competes & reason.isNotNull(), reason).otherwise(F.col("reasons"))
    return checked.join(repeated, key, "left").withColumn("reasons", told).drop("_copies", "_first", "_ties")


def split_rows(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = F.size("reasons") > 0
    return checked.where(~bad).drop("reasons"), checked.where(bad)


def referential_violations(
    child: DataFrame, fk: str | Sequence[str], parent: DataFrame, pk: str | Sequence[str], full: bool = False
) -> DataFrame:
    """Rows whose key has no parent, for keys of one column or of several.

    A key with a null in any column is allowed (SQL's MATCH SIMPLE); with ``full`` only
    one whose columns are all null is, and a key that is null in part is a violation.
    Rows without a whole key never enter the join. Columns of the two tables may bear
    the same names; parents may repeat; all columns of ``child`` come back.
    """
    fk, pk = ([k] if isinstance(k, str) else list(k) for k in (fk, pk))
    if len(fk) != len(pk):
        raise ValueError(f"{fk} refers to {pk}")
    parents = parent.select(*[F.col(p).alias(f"_parent_{i}") for i, p in enumerate(pk)])
    whole = reduce(and_, [F.col(c).isNotNull() for c in fk])
    same = reduce(and_, [F.col(c) == F.col(f"_parent_{i}") for i, c in enumerate(fk)])
    orphans = child.where(whole).join(parents, same, "left_anti")
    if not full:
        return orphans
    return orphans.unionByName(child.where(~whole & reduce(or_, [F.col(c).isNotNull() for c in fk])))
