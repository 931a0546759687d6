"""Raw records: a map of texts next to a map of what each value was.

``raw[k]`` holds a scalar as text and a composite as JSON text; ``raw_kind[k]``
is one of string, number, boolean, object, array, null. A key is absent when its
kind is NULL. Key lookup is case-sensitive.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pick(raw: Column, keys: Sequence[str]) -> Column:
    """Value of the first key that has one; an empty string counts as one."""
    return F.coalesce(*[raw[k] for k in keys])


def string_value(raw: Column, kind: Column, key: str) -> Column:
    """The value under ``key`` when it is a string, else NULL."""
    return F.when(kind[key] == "string", raw[key])


def raw_of(fields: Mapping[str, tuple[Column, str]]) -> tuple[Column, Column]:
    """Raw map and kind map of named columns: ``{name: (column, kind)}``.

    The maps are built from literal keys, so Catalyst turns a lookup back into
    the plain column and prunes the columns nobody asks for.
    """
    raw, kind = [], []
    for name, (column, kind_name) in fields.items():
        raw += [F.lit(name), column.cast("string")]
        kind += [F.lit(name), F.when(column.isNotNull(), F.lit(kind_name))]
    return F.create_map(*raw), F.create_map(*kind)


def variant_kind(value: Column) -> Column:
    """Kind of a VARIANT value; an absent one counts as null."""
    schema = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    return (
        F.when(schema == "STRING", "string")
        .when(schema == "VOID", "null")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .otherwise("number")
    )


def present(raw: Column, kind: Column) -> Column:
    """The raw map without its absent keys."""
    return F.map_filter(raw, lambda k, v: kind[k].isNotNull())
