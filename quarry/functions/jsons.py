"""JSON bodies: typed access at a path, and the canonical text of a scalar."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Scalar = str | int | bool


def variant(body: Column) -> Column:
    """The parsed body, null if it isn't JSON."""
    return F.try_parse_json(body)


def literal_path(segments: list[str]) -> str:
    """The path of nested names taken literally."""
    for s in segments:
        if not s or re.search(r"['\"\\\x00-\x1f]", s):
            raise ValueError(f"not a name: {s!r}")
    return "$" + "".join(f"['{s}']" for s in segments)


def type_at(body: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(variant(body), path, "variant"))


def typed(body: Column, path: str, kind: str) -> Column:
    """The value at ``path`` if its JSON type is ``kind`` (string, bigint or boolean), else null; never coerced."""
    return F.when(type_at(body, path) == {"string": "STRING", "bigint": "BIGINT", "boolean": "BOOLEAN"}[kind], F.try_variant_get(variant(body), path, kind))


def kind_of(value: Scalar) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint"
    if isinstance(value, str):
        return "string"
    raise ValueError(f"a scalar is text, an integer or a boolean, not {type(value).__name__}")


def scalar_text(body: Column, path: str) -> Column:
    """Canonical text of the scalar at ``path``: 1 and "1" are equal; null for missing, null, objects and arrays."""
    kind = type_at(body, path)
    scalar = ~(kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "VOID"))
    return F.when(scalar, F.try_variant_get(variant(body), path, "string"))


def composite_at(body: Column, path: str) -> Column:
    """Whether an object or array stands at ``path``."""
    kind = type_at(body, path)
    return F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))
