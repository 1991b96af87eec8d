"""Names, ids, enumerations and error texts as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def normalise_name(name: Column) -> Column:
    return F.lower(F.translate(name, "- ", "__"))


def is_safe_identifier(name: Column) -> Column:
    """Letters, digits, ``_`` and ``$`` only. ``\\z`` so a trailing newline fails."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9_$]+\z"), F.lit(False))


def offset_chunk_id(migration: Column, table: Column, offset: Column) -> Column:
    return F.concat_ws("#", migration.cast("string"), table, offset.cast("string"))


def ordinal_chunk_id(migration: Column, table: Column, ordinal: Column) -> Column:
    return F.concat_ws("-", migration.cast("string"), table, ordinal.cast("string"))


def normalise_enum(value: Column) -> Column:
    return F.upper(F.trim(value))


def in_enum(value: Column, allowed: Iterable[str]) -> Column:
    return F.coalesce(normalise_enum(value).isin(*allowed), F.lit(False))


def classify_error(message: Column) -> Column:
    """First matching class wins."""
    lowered = F.lower(message)

    def has(*parts: tuple[Column, str]) -> Column:
        test = F.lit(False)
        for text, part in parts:
            test = test | text.contains(part)
        return test

    # Driver error codes and phrases.
    return (
        F.when(has((message, "10060"), (message, "2003"), (lowered, "timed out")), "TIMEOUT")
        .when(has((message, "1045"), (lowered, "access denied")), "AUTH")
        .when(has((message, "1049"), (lowered, "unknown database")), "NO_DATABASE")
        .otherwise("OTHER")
    )


def contains_term(column: Column, term: str) -> Column:
    return F.coalesce(F.lower(column.cast("string")).contains(term.lower()), F.lit(False))
