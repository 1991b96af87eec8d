"""Row images and small JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def encode_image(*fields: Column) -> Column:
    """Fields as JSON; an image without any field is null."""
    text = F.to_json(F.struct(*fields))
    return F.when(text != "{}", text)


def decode_image(text: Column, schema: T.StructType | str) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def topics(json_list: Column) -> Column:
    """A JSON list of names as an array; a missing list is an empty one."""
    return F.coalesce(F.from_json(json_list, "array<string>"), F.array().cast("array<string>"))


def list_allows(json_list: Column, name: Column) -> Column:
    """An empty list allows every name."""
    names = topics(json_list)
    return (F.size(names) == 0) | F.array_contains(names, name)


def change_details(action: Column, table: Column, **rest: Column) -> Column:
    """``{action, table, …}`` with null parts left out."""
    parts = [action.alias("action"), table.alias("table")]
    parts += [column.alias(name) for name, column in rest.items()]
    return F.to_json(F.struct(*parts))
