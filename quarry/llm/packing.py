"""Problem 6: fill containers of fixed capacity by sum-of-squares packing.

Items arrive one after another.  ``N[h]`` is the number of open containers filled to level h.
Putting an item of size s into a container at level h moves that container from level h to h + s;
the level is taken at which the sum of N[h]**2 over all partially filled levels becomes least.
That keeps the levels varied, so that later items find a container they complete.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut

#: Items packed together by one task.
GROUP_ITEMS = 20_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container, level before it) of each item in the order given; sizes in 1..capacity.

    Doubled change of the sum for the choices: a new container 2 N[s] + 1; level h below
    completion 2 (N[h+s] - N[h]) + 2; completing, h + s = capacity, 1 - 2 N[h].  Ties go to
    the fullest level.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    containers, levels = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    made, never = 0, np.iinfo(np.int64).max
    cost = np.empty(capacity + 1, dtype=np.int64)
    for i, s in enumerate(sizes.tolist()):
        top = capacity - s
        here, there = count[: top + 1], count[s:]
        change = cost[: top + 1]
        np.subtract(there, here, out=change)
        change *= 2
        change += 2
        change[top] -= 1
        change[here == 0] = never
        change[0] = 2 * count[s] + 1 if s < capacity else 1
        level = top - int(np.argmin(change[::-1]))
        if level:
            bin_id = open_at[level].pop()
            count[level] -= 1
        else:
            bin_id, made = made, made + 1
        if level + s < capacity:
            open_at[level + s].append(bin_id)
            count[level + s] += 1
        containers[i], levels[i] = bin_id, level
    return containers, levels


def pack(df: DataFrame, key: str, size: str, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(key, piece, size_start, size_end, container, container_start): where every item goes.

    ``size_start`` to ``size_end`` is the part of the item in this container, ``container_start``
    the fill before it.  An item larger than the capacity is cut into full containers and a rest,
    which is packed like an item; no other item is cut.  A repeated key counts once, with its largest
    size; a null key is left out, and so is an item whose size is null or not positive: it needs no
    room.  An empty table gives an empty result.  Other columns are ignored, whatever their names.

    Items are spread over ``ceil(n / group_items)`` groups by a hash of the key and packed in hash
    order within a group, so the result doesn't depend on the input's partitioning.  What lies in a
    group's unfinished containers is packed again, together with that of the other groups, in groups
    of as many items, as long as that takes a fiftieth of the items or less away from the round before; so
    only the last round's containers stay unfinished.  Only keys and sizes move.  Containers are
    numbered ``round * 2**56 + group * 2**32 + number``.
    """
    k, s = F.col(f"`{key}`"), F.col(f"`{size}`").cast("long")
    kind = df.schema[key].dataType.simpleString()
    items = cut(df.select(k.alias("k"), s.alias("s")).filter("k IS NOT NULL AND s > 0").groupBy("k").agg(F.max("s").alias("s")))
    left, at, packed = items.select("k", F.lit(0).cast("long").alias("begin"), "s"), 0, None
    n = items.count()
    while packed is None or left is not None:
        groups = max(1, -(-n // group_items))
        placed = cut(_round(left, kind, capacity, groups, at))
        open_ = placed.filter("fill < container_size")
        n_open = open_.count() if groups > 1 else 0
        again = groups > 1 and 2 * n_open <= n
        done = placed.filter("fill = container_size") if again else placed
        packed = done if packed is None else packed.unionByName(done)
        left = open_.groupBy("k", "piece").agg(F.min("size_start").alias("begin"), F.min(F.col("size_end") - F.col("size_start")).alias("s")).select("k", "begin", "s") if again else None
        n, at = n_open, at + 1
    return packed.select(F.col("k").alias(key), "piece", "size_start", "size_end", "container", "container_start")


def _round(items: DataFrame, kind: str, capacity: int, groups: int, at: int) -> DataFrame:
    """Pack items (k, begin, s), of which ``begin`` lies in containers already; with the fill of each container."""

    def one_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "k"], ignore_index=True)
        g, total, begin = int(pdf["g"].iloc[0]), pdf["s"].to_numpy(dtype=np.int64), pdf["begin"].to_numpy(dtype=np.int64)
        full, rest = np.divmod(total, capacity)
        some = np.flatnonzero(rest)
        bins, levels = sum_of_squares(rest[some], capacity)
        made = int(bins.max()) + 1 if len(bins) else 0
        fills = np.bincount(bins, weights=rest[some], minlength=made).astype(np.int64)
        who = np.repeat(np.arange(len(total)), full)
        piece = np.arange(len(who)) - np.repeat(np.cumsum(full) - full, full)
        rows = np.concatenate([some, who])
        start = begin[rows] + np.concatenate([full[some], piece]) * capacity
        return pd.DataFrame(
            {
                "k": pdf["k"].to_numpy()[rows],
                "piece": (start // capacity).astype("int32"),
                "size_start": start,
                "size_end": start + np.concatenate([rest[some], np.full(len(who), capacity)]),
                "container": (at << 56) + (g << 32) + np.concatenate([bins, made + np.arange(len(who))]),
                "container_start": np.concatenate([levels, np.zeros(len(who), dtype=np.int64)]),
                "fill": np.concatenate([fills[bins], np.full(len(who), capacity)]),
                "container_size": capacity,
            }
        )

    spread = items.withColumn("h", F.xxhash64("k", F.lit(at))).withColumn("g", F.pmod(F.col("h"), F.lit(groups))).repartition(groups, "g").groupBy("g")
    return spread.applyInPandas(one_group, f"k {kind}, piece int, size_start long, size_end long, container long, container_start long, fill long, container_size long")
