"""Prefix sums within groups of any size.

A window partitioned by a group puts the whole group into one task.  Here the rows are
range-partitioned by (group, order) instead, so a group that holds a third of the table is
cut into as many blocks as its share of the rows; each block is summed on its own and
receives what comes before it from a table of block totals.  Only groups that span several
blocks are in that table, so it has at most two rows per partition and is broadcast with
that bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import cut, fresh, shuffle_width


def blocked(df: DataFrame, group: list[str], order: list[str], block: str, partitions: int | None = None) -> DataFrame:
    """``df`` with the column ``block``: the number of the (group, order) range a row lies in.

    Rows equal in group and order share a block.  The result is materialised, because the
    bounds of a range partitioning are sampled and a second evaluation could cut elsewhere.
    """
    n = partitions or shuffle_width(df)
    cols = [F.col(f"`{c}`") for c in [*group, *order]]
    return cut(df.repartitionByRange(n, *cols).withColumn(block, F.spark_partition_id()))


def prefix_sum(df: DataFrame, group: list[str], order: list[str], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the group up to and including this one.

    ``order`` must be unique within a group (pre-aggregate ties).  Null groups form a group of
    their own; nulls in ``order`` come first; a null ``value`` counts as 0.  An empty input gives
    an empty result.  Shuffles: one by range, one by (group, block).
    """
    block, v, local, before = fresh(df, "block", "value", "local", "before")
    cells = blocked(df.withColumn(v, F.coalesce(value, F.lit(0))), group, order, block, partitions)
    keys = [F.col(f"`{c}`") for c in group]
    within = Window.partitionBy(*keys, block).orderBy(*[F.col(f"`{c}`") for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    carry = carried(cells, group, block, {before: F.sum(v)})
    summed = cells.withColumn(local, F.sum(v).over(within))
    joined = with_carry(summed, carry, group, block)
    return joined.withColumn(name, F.col(local) + F.coalesce(F.col(before), F.lit(0))).drop(block, v, local, before)


def carried(cells: DataFrame, group: list[str], block: str, totals: dict[str, Column]) -> DataFrame:
    """Per (group, block) of the groups that span several blocks: each total summed over the earlier blocks."""
    keys = [F.col(f"`{c}`") for c in group]
    per = cells.groupBy(*keys, block).agg(*[t.alias(n) for n, t in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return (
        per.withColumn("__blocks", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        .filter("__blocks > 1")
        .select(*keys, block, *[F.sum(n).over(earlier).alias(n) for n in totals])
    )


def with_carry(rows: DataFrame, carry: DataFrame, group: list[str], block: str) -> DataFrame:
    """Left join of the block carries; the broadcast side has at most two rows per range partition."""
    right = carry.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate([*group, block])], *[c for c in carry.columns if c not in {*group, block}])
    on = [F.col(f"`{c}`").eqNullSafe(F.col(f"__c{i}")) for i, c in enumerate([*group, block])]
    return rows.join(F.broadcast(right), on, "left").drop(*[f"__c{i}" for i in range(len(group) + 1)])


def following(df: DataFrame, group: list[str], order: list[str], columns: list[str], prefix: str = "next_", partitions: int | None = None) -> DataFrame:
    """``df`` with the ``columns`` of the next row of its group in ``order``, named ``prefix`` + name; null for the last.

    ``order`` must be unique within a group.  The last row of a block takes the first row of the group's next block.
    """
    block, pack, lead_ = fresh(df, "block", "pack", "lead")
    cells = blocked(df.withColumn(pack, F.struct(*[F.col(f"`{c}`") for c in columns])), group, order, block, partitions)
    keys, in_order = [F.col(f"`{c}`") for c in group], [F.col(f"`{c}`") for c in order]
    within = Window.partitionBy(*keys, block).orderBy(*in_order)
    first = cells.groupBy(*keys, block).agg(F.min_by(pack, F.struct(*in_order)).alias("__first"))
    later = Window.partitionBy(*keys).orderBy(block)
    carry = first.withColumn("__blocks", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("__blocks > 1").select(*keys, block, F.lead("__first").over(later).alias("__after"))
    joined = with_carry(cells.withColumn(lead_, F.lead(pack).over(within)), carry, group, block)
    after = F.coalesce(F.col(lead_), F.col("__after"))
    return joined.withColumns({f"{prefix}{c}": after[c] for c in columns}).drop(block, pack, lead_, "__after")
