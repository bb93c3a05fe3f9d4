"""Declared attribute projections."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.errors import ProjectionRejected
from quarry.functions.jsons import composite_at, literal_path, scalar_text
from quarry.operators.textindex import postings

ROLES = ("filterable", "rankable", "searchable")


@dataclass(frozen=True)
class Projection:
    """An attribute of the body: ``source`` is the nested path of names, the attribute's own name unless given."""

    name: str
    roles: frozenset[str] = frozenset({"filterable"})
    source: tuple[str, ...] = ()
    full_text: bool = False
    vector: bool = False

    def __post_init__(self):
        if not self.name or re.search(r"['\"\\\x00-\x1f]", self.name):
            raise ProjectionRejected(f"not a name: {self.name!r}")
        if not self.roles or not set(self.roles) <= set(ROLES):
            raise ProjectionRejected(f"roles of {self.name!r} must be among {ROLES}")
        if (self.full_text or self.vector) and "searchable" not in self.roles:
            raise ProjectionRejected(f"{self.name!r} must be searchable to be indexed")
        try:
            literal_path(list(self.source) or [self.name])
        except ValueError as e:
            raise ProjectionRejected(str(e)) from None

    @property
    def path(self) -> str:
        return literal_path(list(self.source) or [self.name])


@dataclass(frozen=True)
class Difference:
    """What a new declaration changes; dropping asks for consent.

    ``built`` has values now; ``deferred`` are newly declared parts that have none yet: ranks, and vectors as long as
    nothing embeds.  A projection may be in both.
    """

    built: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()
    deferred: tuple[str, ...] = ()
    unchanged: tuple[str, ...] = ()
    registry: dict[str, Projection] = field(default_factory=dict)


def configure(registry: dict[str, Projection], wanted: list[Projection], drop: tuple[str, ...] = (), embeds: bool = False) -> Difference:
    names = [p.name for p in wanted]
    if len(set(names)) != len(names):
        raise ProjectionRejected("a name is declared twice")
    if unknown := set(drop) - registry.keys():
        raise ProjectionRejected(f"nothing to drop: {sorted(unknown)}")
    if set(drop) & set(names):
        raise ProjectionRejected("a projection is both declared and dropped")
    changed = [p for p in wanted if p.name in registry and registry[p.name] != p]
    for p in changed:
        if set(registry[p.name].roles) - set(p.roles) or registry[p.name].source != p.source:
            raise ProjectionRejected(f"changing {p.name!r} loses what is there: drop it first")
    new = [p for p in wanted if registry.get(p.name) != p]
    built = [p.name for p in new if set(p.roles) != {"rankable"} and (p.full_text or not p.vector or "filterable" in p.roles or embeds)]
    deferred = [p.name for p in new if "rankable" in p.roles or (p.vector and not embeds)]
    after = {n: p for n, p in registry.items() if n not in drop} | {p.name: p for p in wanted}
    same = [n for n in after if n in registry and registry[n] == after[n]]
    return Difference(tuple(built), tuple(drop), tuple(deferred), tuple(same), after)


def attributes(nodes: DataFrame, registry: dict[str, Projection]) -> DataFrame:
    """(write_cursor, attr_name, attr_value): canonical text of each projected scalar; missing and null give no row, nor does a rank alone."""
    registry = {n: p for n, p in registry.items() if set(p.roles) != {"rankable"}}
    if not registry:
        return nodes.select("write_cursor", F.lit("").alias("attr_name"), F.lit("").alias("attr_value")).filter(F.lit(False))
    each = [F.struct(F.lit(p.name).alias("attr_name"), scalar_text(F.col("body"), p.path).alias("attr_value")) for p in registry.values()]
    return nodes.select("write_cursor", F.explode(F.array(*each)).alias("a")).filter("a.attr_value IS NOT NULL").select("write_cursor", "a.*")


def require_scalars(nodes: DataFrame, registry: dict[str, Projection]) -> None:
    """Reject a batch in which an object or array stands where a projection reads a scalar."""
    for p in registry.values():
        if not nodes.filter(composite_at(F.col("body"), p.path)).isEmpty():
            raise ProjectionRejected(f"{p.name!r} is an object or array in some body")


def projected_text(attrs: DataFrame, name: str) -> DataFrame:
    """Postings of one searchable projection, by node cursor."""
    return postings(attrs.filter(F.col("attr_name") == name), "write_cursor", {name: F.col("attr_value")})


def readiness(nodes: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """(kind, total, ready, failed, pending, state): what of each kind is embedded; anti-join of what isn't."""
    marked = nodes.select("write_cursor", "kind").join(done.select("write_cursor").distinct().withColumn("ok", F.lit(1)), "write_cursor", "left").join(failed.select("write_cursor").distinct().withColumn("bad", F.lit(1)), "write_cursor", "left")
    counted = marked.groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.count("ok").alias("ready"), F.count_if(F.col("ok").isNull() & F.col("bad").isNotNull()).alias("failed"))
    pending = F.col("total") - F.col("ready") - F.col("failed")
    state = F.when(pending > 0, "pending").when(F.col("failed") > 0, "failed").otherwise("up_to_date")
    return counted.withColumn("pending", pending).withColumn("state", state)
