"""Continuous periods and gaps of overlapping, nested or gapped intervals (problem 4).

Sweep line.  An interval is +1 at its start and -1 at its end; the boundaries of an entity,
summed per instant, are prefix-summed in time order.  A period opens where the count leaves
zero and ends where it returns to zero; between the end of one and the start of the next
lies a gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.prefix import blocked, with_carry

OPEN_END = 253402300799  # 9999-12-31T23:59:59Z, written where an interval has no end
_NEVER = 2**63 - 1


def boundary_events(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, at, delta): the boundaries of all usable intervals, summed per instant.

    Usable: start not null, end null (open) or after start.  Instants at which as many
    intervals end as begin change nothing and are left out, which joins touching intervals.
    """
    s, e = F.col(f"`{start}`").cast("long"), F.col(f"`{end}`").cast("long")
    usable = df.filter(s.isNotNull() & (e.isNull() | (e > s)))
    both = F.array(F.struct(s.alias("at"), F.lit(1).cast("long").alias("delta")), F.struct(F.coalesce(e, F.lit(_NEVER)).alias("at"), F.lit(-1).cast("long").alias("delta")))
    return (
        usable.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.explode(both).alias("b"))
        .groupBy(*[f"__k{i}" for i in range(len(keys))], F.col("b.at").alias("at"))
        .agg(F.sum("b.delta").alias("delta"))
        .filter("delta != 0")
    )


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, partitions: int | None = None) -> DataFrame:
    """(keys, span, span_start, span_end): one row per continuous period and per gap between two.

    Intervals are half-open.  A null end is open and comes out as ``OPEN_END``; an interval
    with a null start, or an end not after its start, is no interval.  Periods that overlap or
    touch are one.  Repeated rows change nothing; null keys form an entity like any other; an
    entity without a usable interval has no rows; an empty table gives an empty result; columns
    other than the named ones are ignored, whatever their names.

    An entity of any size is cut by time into blocks (see ``prefix``).  Counts never fall below
    zero, so within a block the count can only reach zero where the block's own running sum is at
    its minimum; a block's total, that minimum, and the last place of it are therefore all that
    later blocks need, and one round of carries serves both counts and open boundaries.
    """
    k = [f"__k{i}" for i in range(len(keys))]
    cells = blocked(boundary_events(df, keys, start, end), k, ["at"], "block", partitions)
    by_block = Window.partitionBy(*k, "block")
    in_time = by_block.orderBy("at")
    local = cells.withColumn("local", F.sum("delta").over(in_time.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next_at", F.lead("at").over(in_time))

    # What a block leaves behind, as a function of the count that enters it.
    low = local.groupBy(*k, "block").agg(
        F.sum("delta").alias("total"),
        F.min("local").alias("lowest"),
        F.max_by(F.struct("at", "next_at"), F.struct(-F.col("local"), F.col("at"))).alias("zero"),
        F.min("at").alias("first_at"),
    )
    spans_blocks = Window.partitionBy(*k)
    earlier = spans_blocks.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entering = low.withColumn("blocks", F.count(F.lit(1)).over(spans_blocks)).filter("blocks > 1").withColumn("c", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    reaches_zero = F.col("c") + F.col("lowest") == 0
    left = entering.select(
        *k,
        "block",
        "c",
        F.when(reaches_zero, F.col("zero.at")).alias("ended"),
        # The start of a period that is open when the block ends, if it began in this block.
        F.when(reaches_zero, F.col("zero.next_at")).when(F.col("c") == 0, F.col("first_at")).alias("opened"),
    )
    carry = left.select(*k, "block", F.col("c").alias("entering"), F.last("ended", True).over(earlier).alias("before_end"), F.last("opened", True).over(earlier).alias("before_start"))

    counted = with_carry(local, carry, k, "block").withColumn("active", F.coalesce("entering", F.lit(0)) + F.col("local"))
    opens, closes = F.col("active") == F.col("delta"), F.col("active") == 0
    turns = counted.filter(opens | closes)
    previous = F.lag("at").over(in_time)
    spans = turns.select(
        *k,
        F.when(closes, F.lit("period")).otherwise(F.lit("gap")).alias("span"),
        F.coalesce(previous, F.when(closes, F.col("before_start")).otherwise(F.col("before_end"))).alias("span_start"),
        F.col("at").alias("span_end"),
    ).filter("span_start IS NOT NULL")
    out: list[Column] = [F.col(a).alias(b) for a, b in zip(k, keys)]
    return spans.select(*out, "span", "span_start", F.when(F.col("span_end") == _NEVER, F.lit(OPEN_END)).otherwise(F.col("span_end")).alias("span_end"))
