"""Connected components by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star operation on (a, b), a > b: the neighbours of each node are attached to the least of them.

    ``both_ways`` makes it a large star (from each node, its larger neighbours move), else a small
    star (its smaller neighbours, and itself, move).  The least neighbour is taken with map-side
    combining and joined back, so a node with a third of all links is never gathered.
    """
    if both_ways:
        directed = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
    else:
        directed = edges.select(F.col("a").alias("n"), F.col("b").alias("m"))
    least = directed.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
    joined = directed.join(least, "n")
    if both_ways:
        moved = joined.filter("m > n").select(F.col("m").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.filter("m != least").select(F.col("m").alias("a"), F.col("least").alias("b")).unionByName(least.filter("n != least").select(F.col("n").alias("a"), F.col("least").alias("b")))
    return moved.filter("a != b").distinct()


def components(links: DataFrame, a: str, b: str, most_rounds: int = 50) -> DataFrame:
    """(node, root): every node that has a link, and the least node of its component.

    Links may be repeated, reversed or loops; nulls are ignored; an empty table gives an empty
    result.  Each round writes the links to the checkpoint folder; rounds end when a round changes
    nothing, after a number that grows with the logarithm of the longest chain.
    """
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    edges = cut(links.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        edges = cut(_star(_star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
