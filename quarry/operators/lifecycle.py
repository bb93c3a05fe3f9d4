"""Writes, versions, lifecycle, erasure, lineage and integrity.

State is data: each verb is a function from the current tables to the next ones, so a commit is a
new version of the affected tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import IllegalTransition, InvalidArgument, UnknownCollection, WriteRejected
from quarry.operators.prefix import following, prefix_sum

# Lifecycle changes a caller may make; purging asks for deleted.
TRANSITIONS = {("pending", "active"), ("pending", "deleted"), ("active", "deleted"), ("deleted", "active")}
RESERVED = "_"


def supersede(rows: DataFrame, key: str = "logical_id", cursor: str = "write_cursor") -> DataFrame:
    """All versions with ``superseded_at``: the cursor of the next version of the same key; rows without key stay current."""
    keyed = following(rows.filter(F.col(key).isNotNull()), [key], [cursor], [cursor]).withColumnRenamed(f"next_{cursor}", "superseded_at")
    return keyed.unionByName(rows.filter(F.col(key).isNull()).withColumn("superseded_at", F.lit(None).cast("long")))


def assign_cursors(batch: DataFrame, order: list[str], after: int, cursor: str = "write_cursor") -> DataFrame:
    """One cursor per row, in input order, following ``after``; no single task sorts the whole batch."""
    return prefix_sum(batch.withColumn("__all", F.lit(0)), ["__all"], order, F.lit(1), cursor).withColumn(cursor, F.col(cursor) + after).drop("__all")


def node_problems() -> Column:
    """Names of the rules a node row breaks."""
    window = F.col("valid_from").isNotNull() & F.col("valid_until").isNotNull() & (F.col("valid_until") <= F.col("valid_from"))
    rules = {
        "source_id missing": F.col("source_id").isNull() | (F.trim("source_id") == ""),
        "source_id reserved": F.col("source_id").startswith(RESERVED),
        "kind missing": F.col("kind").isNull() | (F.col("kind") == ""),
        "body missing": F.col("body").isNull(),
        "state unknown": ~F.coalesce(F.col("state").isin("active", "pending"), F.lit(False)),
        "window empty": window,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))


def edge_problems() -> Column:
    rules = {
        "source_id missing": F.col("source_id").isNull() | (F.trim("source_id") == ""),
        "source_id reserved": F.col("source_id").startswith(RESERVED),
        "endpoint missing": F.col("from_id").isNull() | F.col("to_id").isNull(),
        "separator in id": F.col("from_id").contains("\x1e") | F.col("to_id").contains("\x1e"),
        "kind missing": F.col("kind").isNull() | (F.col("kind") == ""),
        "confidence out of range": (F.col("confidence") < 0) | (F.col("confidence") > 1) | F.isnan("confidence"),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))


def accept(batch: DataFrame, problems: Column) -> DataFrame:
    """The batch if no row breaks a rule; else nothing of it, with the first few reasons."""
    bad = batch.select(problems.alias("p")).filter(F.size("p") > 0).limit(5).collect()
    if bad:
        raise WriteRejected("; ".join(sorted({x for r in bad for x in r.p})))
    return batch


def high_water(*tables: DataFrame, cursor: str = "write_cursor") -> DataFrame:
    """The largest cursor of all tables, 0 when empty."""
    each = [t.agg(F.max(cursor).alias("c")) for t in tables]
    out = each[0]
    for t in each[1:]:
        out = out.unionByName(t)
    return out.agg(F.coalesce(F.max("c"), F.lit(0)).alias("high_water"))


def transition(nodes: DataFrame, logical_id: str, to_state: str, reason: str | None = None) -> DataFrame:
    """The nodes with one id in its new state."""
    mine = (F.col("logical_id") == logical_id) & F.col("superseded_at").isNull()
    states = {r[0] for r in nodes.filter(mine).select("state").limit(2).collect()}
    if not states:
        raise InvalidArgument(f"no node {logical_id!r}")
    for s in states:
        if (s, to_state) not in TRANSITIONS:
            raise IllegalTransition(f"{s} to {to_state}")
    return nodes.withColumn("state", F.when(mine, F.lit(to_state)).otherwise(F.col("state"))).withColumn("reason", F.when(mine, F.lit(reason)).otherwise(F.col("reason")))


def final_states(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """(logical_id, state, accepted, refused) after ``requests`` (logical_id, step, to_state) are applied in order, illegal ones refused.

    The machine has three states, so a request is a map of states to states; folding a key's maps in
    order is a fold over its few requests.
    """
    asked = requests.groupBy("logical_id").agg(F.array_sort(F.collect_list(F.struct("step", "to_state"))).alias("asked"))
    legal = F.array(*[F.lit(f"{a}>{b}") for a, b in sorted(TRANSITIONS)])
    start = F.struct(F.col("state").alias("state"), F.lit(0).alias("accepted"), F.lit(0).alias("refused"))

    def step(acc: Column, r: Column) -> Column:
        ok = F.array_contains(legal, F.concat(acc["state"], F.lit(">"), r["to_state"]))
        return F.struct(F.when(ok, r["to_state"]).otherwise(acc["state"]).alias("state"), (acc["accepted"] + F.when(ok, 1).otherwise(0)).alias("accepted"), (acc["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"))

    return nodes.select("logical_id", "state").join(asked, "logical_id").select("logical_id", F.aggregate("asked", start, step).alias("r")).select("logical_id", "r.*")


def purge(nodes: DataFrame, edges: DataFrame, logical_id: str, shadows: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """All tables without a deleted node, its edges and what was derived from them; purging twice changes nothing."""
    mine = nodes.filter(F.col("logical_id") == logical_id)
    if not mine.filter(F.col("superseded_at").isNull() & (F.col("state") != "deleted")).isEmpty():
        raise IllegalTransition("purge asks for a deleted node")
    return purge_all(nodes, edges, nodes.sparkSession.createDataFrame([(logical_id,)], "logical_id string"), shadows)


def purge_all(nodes: DataFrame, edges: DataFrame, ids: DataFrame, shadows: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """All tables without the nodes of ``ids`` (logical_id), all their versions and edges, and what was derived from them."""
    gone = ids.filter("logical_id IS NOT NULL").select("logical_id").distinct()
    kept_nodes = nodes.join(gone, "logical_id", "left_anti").select(*nodes.columns)
    ends = [gone.withColumnRenamed("logical_id", side) for side in ("from_id", "to_id")]
    kept_edges = edges.join(ends[0], "from_id", "left_anti").join(ends[1], "to_id", "left_anti").select(*edges.columns)
    touched = [edges.join(end, end.columns[0], "left_semi").select("write_cursor") for end in ends]
    cursors = nodes.join(gone, "logical_id", "left_semi").select("write_cursor").unionByName(touched[0]).unionByName(touched[1]).distinct()
    return kept_nodes, kept_edges, {n: t.join(cursors, "write_cursor", "left_anti").select(*t.columns) for n, t in shadows.items()}


def erase_source(source_id: str, tables: dict[str, DataFrame], shadows: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the rows of a source or derived from them, and (table, erased): the counts."""
    gone = None
    for t in tables.values():
        rows = t.filter(F.col("source_id") == source_id).select("write_cursor")
        gone = rows if gone is None else gone.unionByName(rows)
    gone = gone.distinct()
    kept = {n: t.filter(~F.coalesce(F.col("source_id") == source_id, F.lit(False))) for n, t in tables.items()}
    kept |= {n: t.join(gone, "write_cursor", "left_anti") for n, t in shadows.items()}
    counts = None
    for n, t in (tables | shadows).items():
        hit = t.filter(F.col("source_id") == source_id) if n in tables else t.join(gone, "write_cursor", "left_semi")
        one = hit.agg(F.count(F.lit(1)).alias("erased")).select(F.lit(n).alias("table_name"), "erased")
        counts = one if counts is None else counts.unionByName(one)
    return kept, counts


def excise_record(log: DataFrame, latest: DataFrame, collection: str, record_key: str) -> tuple[DataFrame, DataFrame]:
    mine = (F.col("collection_name") == collection) & (F.col("record_key") == record_key)
    return log.filter(~mine), latest.filter(~mine)


def retained(log: DataFrame, cap: int, order: str = "id", exempt: Column | None = None, slack: float = 1.05) -> DataFrame:
    """The newest ``cap`` rows once the log exceeds the cap by the slack; exempt rows always stay and don't count.

    The bound is the order value of the cap-th newest row, found by counting rows per order range, so no
    task sorts the log.
    """
    counted = log.filter(~exempt) if exempt is not None else log
    n = counted.count()
    if n <= int(cap * slack):
        return log
    low = counted.select(order).orderBy(F.col(order).desc()).limit(cap).agg(F.min(order).alias("low"))
    keep = F.col(order) >= F.col("low")
    return log.crossJoin(F.broadcast(low)).filter(keep | exempt if exempt is not None else keep).drop("low")


def trace_source(source_id: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(row_kind, write_cursor): all rows that came from a source."""
    of = lambda t, n: t.filter(F.col("source_id") == source_id).select(F.lit(n).alias("row_kind"), "write_cursor").distinct()
    return of(nodes, "node").unionByName(of(edges, "edge"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def provenance_census(rows: DataFrame) -> DataFrame:
    """(source_id, row_count, current, addressable, reserved) per source; the null source holds the rows nothing can erase."""
    return rows.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("superseded_at").isNull()).alias("current_rows"),
        F.count_if(F.col("logical_id").isNotNull()).alias("addressable_rows"),
        F.coalesce(F.max(F.col("source_id").startswith(RESERVED)), F.lit(False)).alias("reserved"),
    )


def latest_state(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key; combined map-side, so a key with a third of the log is no hot spot."""
    others = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(*keys, "r.*")


def append(registry: dict[str, str], log: DataFrame, rows: DataFrame, collection: str) -> DataFrame:
    """The log with rows of a registered append-only or latest-state collection."""
    if collection not in registry:
        raise UnknownCollection(collection)
    return log.unionByName(rows.withColumn("collection_name", F.lit(collection)), allowMissingColumns=True)


def integrity_findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(finding, rows) of each rule that is broken somewhere: physical, logical and semantic."""
    current_nodes = nodes.filter(F.col("superseded_at").isNull())
    checks: Iterable[tuple[str, DataFrame]] = [
        ("cursor used twice", nodes.select("write_cursor").unionByName(edges.select("write_cursor")).groupBy("write_cursor").count().filter("count > 1")),
        ("two current versions", current_nodes.filter("logical_id IS NOT NULL").groupBy("logical_id").count().filter("count > 1")),
        ("empty validity", nodes.filter("valid_until <= valid_from")),
        ("edge ends before it starts", edges.filter("t_invalid <= t_valid")),
        ("confidence out of range", edges.filter("confidence < 0 OR confidence > 1")),
        ("dangling endpoint", dangling_endpoints(edges, nodes)),
    ]
    out = None
    for name, rows in checks:
        one = rows.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("finding"), "row_count").filter("row_count > 0")
        out = one if out is None else out.unionByName(one)
    return out


def dangling_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(write_cursor, side, id): each endpoint of an edge that no active current node has."""
    ends = edges.selectExpr("write_cursor", "stack(2, 'from', from_id, 'to', to_id) AS (side, id)")
    versions = nodes.filter(F.col("superseded_at").isNull()) if "superseded_at" in nodes.columns else nodes
    known = versions.filter(F.col("state") == "active").select(F.col("logical_id").alias("id")).distinct()
    return ends.join(known, "id", "left_anti").select("write_cursor", "side", "id")
