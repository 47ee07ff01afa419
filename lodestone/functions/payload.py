"""Open metadata of chunks: a VARIANT object of any keys, and filters on them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = "metadata"


def payload(json: Column) -> Column:
    """The VARIANT of a JSON text; null for a text that is none."""
    return F.try_parse_json(json)


def same(payload: Column, key: str, value: str | int | bool) -> Column:
    """Whether the payload has a key with that value, of that type: 1, true and "1" differ. Never null: a null payload, one
    that is no object, an unknown key, and a value that is no string, whole number or boolean match nothing."""
    kinds = {bool: ("BOOLEAN", "boolean"), int: ("BIGINT", "bigint"), str: ("STRING", "string")}
    if type(value) not in kinds:
        return F.lit(False)
    name, kind = kinds[type(value)]
    if re.fullmatch(r"\w+", key, re.ASCII):
        path = f"$.{key}"
        held, got = F.try_variant_get(payload, path, "variant"), F.try_variant_get(payload, path, kind)
    else:  # keys that no path can name
        held = F.try_variant_get(payload, "$", "map<string,variant>")[key]
        got = F.try_variant_get(held, "$", kind)
    return F.coalesce((F.schema_of_variant(held) == name) & (got == F.lit(value)), F.lit(False))


def meets(filters: dict[str, object] | None, columns: list[str], fields: list[str]) -> Column:
    """Whether a row meets all filters: those named by one of `fields` by the row's column, others by its metadata. A field
    wins over a key of its name; a name that is neither matches nothing."""
    ok = F.lit(True)
    for name, value in (filters or {}).items():
        if name in fields:
            ok &= F.coalesce(F.col(name) == value, F.lit(False))
        else:
            ok &= same(F.col(NAME), name, value) if NAME in columns else F.lit(False)
    return ok
