"""Point reads, lists, paging and boundary crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.errors import InvalidArgument
from quarry.operators.filters import Filter, Json
from quarry.operators.views import DEFAULT_VIEW, ReadView

MOST_PAGED = 1_000_000


def get(nodes: DataFrame, logical_id: str, now: int, view: ReadView = DEFAULT_VIEW) -> DataFrame:
    """The node of one id, or nothing."""
    return view.of(nodes.filter(F.col("logical_id") == logical_id), now).limit(1)


def get_many(nodes: DataFrame, ids: DataFrame, now: int, view: ReadView = DEFAULT_VIEW) -> DataFrame:
    """``ids`` (pos, logical_id) with the node of each, null columns for a miss; order by pos."""
    found = view.of(nodes, now)
    return ids.join(found, "logical_id", "left")


def list_nodes(nodes: DataFrame, kind: str, now: int, *, where: Filter = Filter(), predicates: tuple[Json, ...] = (), limit: int = 100, view: ReadView = DEFAULT_VIEW, attributes: DataFrame | None = None) -> DataFrame:
    """Nodes of a kind that satisfy every predicate, first by cursor."""
    if not 0 <= limit <= MOST_PAGED:
        raise InvalidArgument(f"limit {limit}")
    both = Filter(where.source_type, where.kind, where.created_after, where.status, (*where.json, *predicates), where.attributes)
    return view.of(both.for_list(nodes, kind, attributes), now).orderBy("write_cursor").limit(limit)


def page(log: DataFrame, after: int, limit: int, order: str = "id") -> DataFrame:
    """The next ``limit`` rows after cursor ``after``, exclusive."""
    if limit < 0:
        raise InvalidArgument(f"limit {limit}")
    return log.filter(F.col(order) > after).orderBy(order).limit(min(limit, MOST_PAGED))


def crossed_boundary(nodes: DataFrame, since: int, now: int, view: ReadView = DEFAULT_VIEW) -> DataFrame:
    """Nodes whose validity began or ended within (since, as of], with both flags; existence is honoured."""
    until = now if view.valid_as_of is None else view.valid_as_of
    began = F.coalesce((F.col("valid_from") > since) & (F.col("valid_from") <= until), F.lit(False))
    ended = F.coalesce((F.col("valid_until") > since) & (F.col("valid_until") <= until), F.lit(False))
    exists = ReadView(view.include_superseded, view.include_inactive, True).condition(now, nodes.columns)
    return nodes.filter(exists & (began | ended)).withColumns({"began": began, "ended": ended})


def as_of_versions(versions: DataFrame, instants: DataFrame, key: str, at: str, start: str = "valid_from", end: str = "valid_until", grid: int = 86_400 * 30) -> DataFrame:
    """Each (key, at) of ``instants`` with the versions valid then.

    A version is laid out over the cells of a time grid that it touches, up to ``MOST_CELLS``; an instant looks in its
    own cell, so the join is on equality.  Longer and unbounded versions join on the key alone.
    """
    s, e = F.coalesce(F.col(start), F.lit(-(2**62))), F.coalesce(F.col(end), F.lit(2**62))
    cells = F.floor((e - 1) / grid) - F.floor(s / grid)
    marked = versions.withColumn("__s", s).withColumn("__e", e).withColumn("__cells", cells)
    short = marked.filter(F.col("__cells") < MOST_CELLS).withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__s") / grid), F.floor((F.col("__e") - 1) / grid))))
    asked = instants.withColumn("__cell", F.floor(F.col(at) / grid))
    inside: Column = (F.col("__s") <= F.col(at)) & (F.col(at) < F.col("__e"))
    a = asked.join(short, [key, "__cell"]).filter(inside)
    b = asked.join(marked.filter(F.col("__cells") >= MOST_CELLS), key).filter(inside)
    drop = ["__cell", "__s", "__e", "__cells"]
    return a.drop(*drop).unionByName(b.drop(*drop))


MOST_CELLS = 400


def numbered(ids: DataFrame, column: str = "logical_id") -> DataFrame:
    """Ids with their request position."""
    return ids.withColumn("pos", F.row_number().over(Window.orderBy(column)))
