"""The closed filter grammar (P3-P15) and its lowering to Columns.

Listing takes every term.  Search takes the envelope terms and attributes, and applies them before
ranking; a JSON term on search is rejected rather than applied afterwards.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import InvalidFilter
from quarry.functions import jsons

# The paths a predicate may name, the comparisons, and the source type of each kind.
JSON_PATHS = ("$.status", "$.priority", "$.tags", "$.kind", "$.created_at", "$.action_kind")
COMPARISONS = ("gt", "gte", "lt", "lte")
SOURCE_TYPES = {"email": "email", "article": "article", "paper": "paper", "meeting": "meeting", "note": "note", "todo": "todo", "doc": "article"}


def source_type_of(kind: str) -> str:
    if kind not in SOURCE_TYPES:
        raise InvalidFilter(f"kind {kind!r} has no source type")
    return SOURCE_TYPES[kind]


def source_type(kind: Column) -> Column:
    pairs = [F.lit(x) for kv in SOURCE_TYPES.items() for x in kv]
    return F.create_map(*pairs)[kind]


@dataclass(frozen=True)
class Json:
    """A typed predicate on the body: ``op`` eq, gt, gte, lt or lte."""

    path: str
    value: jsons.Scalar
    op: str = "eq"

    def __post_init__(self):
        if self.path not in JSON_PATHS:
            raise InvalidFilter(f"path {self.path!r} isn't in {JSON_PATHS}")
        if self.op not in ("eq", *COMPARISONS):
            raise InvalidFilter(f"no such comparison: {self.op!r}")
        try:
            kind = jsons.kind_of(self.value)
        except ValueError as e:
            raise InvalidFilter(str(e)) from None
        if self.op != "eq" and kind == "boolean":
            raise InvalidFilter("booleans have no order")

    def column(self, body: Column) -> Column:
        got, want = jsons.typed(body, self.path, jsons.kind_of(self.value)), F.lit(self.value)
        tests = {"eq": got == want, "gt": got > want, "gte": got >= want, "lt": got < want, "lte": got <= want}
        return F.coalesce(tests[self.op], F.lit(False))


@dataclass(frozen=True)
class Filter:
    """All given terms must hold; ``attributes`` are equalities on filterable projections, by canonical text."""

    source_type: str | None = None
    kind: str | None = None
    created_after: int | None = None
    status: str | None = None
    json: tuple[Json, ...] = ()
    attributes: dict[str, jsons.Scalar] = field(default_factory=dict)

    def __post_init__(self):
        for name in self.attributes:
            if not name or re.search(r"['\"\\\x00-\x1f]", name):
                raise InvalidFilter(f"not an attribute name: {name!r}")

    def contradicts(self, kind: str) -> bool:
        """Whether listing ``kind`` can be answered without touching storage: nothing can match."""
        if self.kind is not None and self.kind != kind:
            return True
        return self.source_type is not None and SOURCE_TYPES.get(kind) != self.source_type

    def envelope(self, columns: list[str]) -> Column:
        out = F.lit(True)
        if self.source_type is not None:
            out = out & ((F.col("source_type") if "source_type" in columns else source_type(F.col("kind"))) == self.source_type)
        if self.kind is not None:
            out = out & (F.col("kind") == self.kind)
        if self.created_after is not None:
            out = out & (F.col("created_at") >= self.created_after)
        if self.status is not None:
            # Rows without a status carry the empty one, which no asked status equals.
            out = out & (F.coalesce(F.col("status"), F.lit("")) == self.status) & F.lit(self.status != "")
        return F.coalesce(out, F.lit(False))

    def for_list(self, rows: DataFrame, kind: str, attributes: DataFrame | None = None) -> DataFrame:
        if self.contradicts(kind):
            return rows.filter(F.lit(False))
        out = rows.filter((F.col("kind") == kind) & Filter(created_after=self.created_after, status=self.status).envelope(rows.columns))
        for term in self.json:
            out = out.filter(term.column(F.col("body")))
        return self._with_attributes(out, attributes)

    def for_search(self, rows: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
        if self.json:
            raise InvalidFilter("a JSON term can't be applied before ranking")
        return self._with_attributes(rows.filter(self.envelope(rows.columns)), attributes)

    def _with_attributes(self, rows: DataFrame, attributes: DataFrame | None) -> DataFrame:
        for name, value in self.attributes.items():
            if attributes is None:
                raise InvalidFilter(f"no filterable projection {name!r}")
            text = ("true" if value else "false") if isinstance(value, bool) else str(value)
            having = attributes.filter((F.col("attr_name") == name) & (F.col("attr_value") == text)).select("write_cursor").distinct()
            rows = rows.join(having, "write_cursor", "left_semi")
        return rows
