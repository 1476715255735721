"""Typed getters with defaults over VARIANT values: dictionaries and arrays of any depth."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The value of a JSON text; null where it isn't one."""
    return F.try_parse_json(text)


def path(*steps: str | int) -> str:
    """The way to a value: names of keys and places in arrays, a place below 0 counting from nothing.

    Keys may hold any characters but both kinds of quotes at once.
    """
    out = "$"
    for s in steps:
        if isinstance(s, int):
            if s < 0:
                raise ValueError("places count from 0")
            out += f"[{s}]"
        elif "'" not in s:
            out += f"['{s}']"
        elif '"' not in s:
            out += f'["{s}"]'
        else:
            raise ValueError(f"a key can't hold both kinds of quotes: {s!r}")
    return out


def get(value: Column, kind: str, default: Any, *steps: str | int) -> Column:
    """The value at ``steps`` as ``kind`` (a Spark type), or the default where there is none, a null, or one that isn't of the kind.

    Numbers in texts are no numbers and numbers no texts, as the getters of typed objects
    have it: a value counts if its own kind is the wanted one, where whole numbers are
    decimals, too, and decimals are cut to whole numbers.
    """
    at = path(*steps)
    own = F.schema_of_variant(F.try_variant_get(value, at, "variant"))
    numbers = own.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL.*|FLOAT|DOUBLE)$")
    fits = {"string": own == "STRING", "boolean": own == "BOOLEAN"}.get(kind, numbers if kind in ("int", "long", "bigint", "double", "float") or kind.startswith("decimal") else F.lit(True))
    return F.coalesce(F.when(fits, F.try_variant_get(value, at, kind)), F.lit(default).cast(kind))


def size(value: Column, *steps: str | int) -> Column:
    """How many entries the array at ``steps`` has; 0 where there is none."""
    return F.coalesce(F.size(F.try_variant_get(value, path(*steps), "array<variant>")), F.lit(0)) if steps else F.coalesce(F.size(F.try_variant_get(value, "$", "array<variant>")), F.lit(0))


def has(value: Column, *steps: str | int) -> Column:
    """Whether something stands at ``steps``, if only a null."""
    return F.try_variant_get(value, path(*steps), "variant").isNotNull()
