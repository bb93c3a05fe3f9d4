"""Problem 5: one ranking from scores on different scales, by leximin over percentiles.

Each score becomes the share of the pool's items that stand strictly below the item in it.  An item's
percentiles are sorted ascending and items are compared by these arrays lexicographically, the higher
first: the weakest score decides, the next weakest breaks its ties, and no score can hide another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.prefix import blocked, prefix_sum, with_carry
from quarry.session import cut


def _comparable(score: Column) -> Column:
    """Double with NaN as null, and one zero."""
    s = score.cast("double")
    return F.when(~F.isnan(s), s + F.lit(0.0))


def _below(items: DataFrame, score: str, name: str) -> DataFrame:
    """``items`` with ``name``, how many of the pool's items have a lower ``score``, null being lowest, and ``size`` of the pool.

    Rows are range-partitioned by (pool, score, item), so a pool, or one score that many of its items have, is spread over
    tasks.  Each block counts on its own; of the pools that span blocks, a table with a row per block tells how many rows
    lie in earlier ones, and how many of these have the block's first score.
    """
    cells = blocked(items.drop("size"), ["pool"], [score, "item"], "block")
    runs = cells.groupBy("pool", "block", score).agg(F.count(F.lit(1)).alias("same"))
    s = F.struct(F.col(score).alias("s"))  # nulls compare as lowest inside a struct
    per = runs.groupBy("pool", "block").agg(F.sum("same").alias("n"), F.min(s).alias("first"), F.max(s).alias("last"), F.max_by("same", s).alias("tail"))
    of_pool = Window.partitionBy("pool")
    spanning = cut(per.withColumn("blocks", F.count(F.lit(1)).over(of_pool)).filter("blocks > 1"))
    earlier = of_pool.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = spanning.select("pool", "block", "first", F.sum("n").over(earlier).alias("before"), F.sum("n").over(of_pool).alias("total"))
    ends = spanning.select(F.col("pool").alias("p"), F.col("block").alias("b"), "last", "tail")
    ties = counts.join(ends, (F.col("p") == F.col("pool")) & F.col("first").eqNullSafe(F.col("last")) & (F.col("b") < F.col("block"))).groupBy("pool", "block").agg(F.sum("tail").alias("ties"))
    carry = counts.join(ties, ["pool", "block"], "left")
    local = Window.partitionBy("pool", "block")
    ranked = cells.withColumn("rank", F.rank().over(local.orderBy(score))).withColumn("here", F.count(F.lit(1)).over(local))
    joined = with_carry(ranked, carry, ["pool"], "block")
    tied = F.when(F.struct(F.col(score).alias("s")).eqNullSafe(F.col("first")), F.coalesce("ties", F.lit(0))).otherwise(0)
    lower = F.col("rank") - 1 + F.coalesce("before", F.lit(0)) - tied
    return joined.withColumn(name, lower).withColumn("size", F.coalesce("total", "here")).drop("block", "rank", "here", "first", "before", "total", "ties")


def leximin(df: DataFrame, pool: str, item: str, scores: list[str]) -> DataFrame:
    """(pool, item, standing): per item the ascending array of its percentiles, from 0 (lowest) to 1.

    An item listed more than once in a pool counts once, with its highest value of each score.  A null or
    NaN score is below all others, and such items are equal in it; infinite scores are ordinary extremes.
    Equal scores have equal percentiles.  In a pool of one item all percentiles are 0.  Rows with a null
    pool or item are left out; an empty table gives an empty result; other columns are ignored, whatever
    their names.
    """
    names = [f"s{i}" for i in range(len(scores))]
    rows = df.select(F.col(f"`{pool}`").alias("pool"), F.col(f"`{item}`").alias("item"), *[_comparable(F.col(f"`{c}`")).alias(n) for c, n in zip(scores, names)])
    items = rows.filter("pool IS NOT NULL AND item IS NOT NULL").groupBy("pool", "item").agg(*[F.max(n).alias(n) for n in names])
    for n in names:
        items = _below(items, n, f"below_{n}")
    share = [F.col(f"below_{n}") / F.greatest(F.col("size") - 1, F.lit(1)) for n in names]
    return items.select(F.col("pool").alias(pool), F.col("item").alias(item), F.array_sort(F.array(*share)).alias("standing"))


def top(df: DataFrame, pool: str, item: str, scores: list[str], n: int) -> DataFrame:
    """(pool, item, standing, place): the first ``n`` of each pool; equal arrays are ordered by item.

    Each task drops what can't be among the first ``n`` before anything is moved.
    """
    order = Window.partitionBy(pool).orderBy(F.col("standing").desc(), F.col(item))
    ranked = leximin(df, pool, item, scores)
    return ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def ranking(df: DataFrame, pool: str, item: str, scores: list[str]) -> DataFrame:
    """(pool, item, standing, place): the whole ranking of each pool, whatever its size."""
    stood = leximin(df, pool, item, scores)
    best_first = F.transform("standing", lambda x: -x)
    placed = prefix_sum(stood.withColumn("order", best_first), [pool], ["order", item], F.lit(1), "place")
    return placed.select(pool, item, "standing", "place")
