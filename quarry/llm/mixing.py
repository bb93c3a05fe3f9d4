"""Problem 7: mix sources to target shares of the total size, by entropy balancing.

Each document gets a rate, the number of times it should be used.  Among all rates that meet the
size constraint of every source and stay within its cap, those closest to "use everything once" in
relative entropy are ``min(cap, exp(lambda_source * size))``: the documents of a source are tilted
exponentially by size.  The lambdas maximise a concave dual that separates by source; Newton steps,
kept inside a bracket, find all of them at once.  A step needs two sums per source, which Spark
takes over the counts of (source, size).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.prefix import prefix_sum
from quarry.session import cut

#: Most rows the table of targets may have; it is read by the driver and broadcast.
MOST_SOURCES = 10_000
#: Rates are rounded in whole steps of this fraction, so that sums are exact.
STEP = 1 << 20


@dataclass
class Target:
    """One source's constraint and the state of its Newton iteration."""

    source: str
    share: float
    cap: int
    size: int = 0
    scale: float = 1.0
    tilt: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    done: bool = False
    wanted: float = 0.0

    @property
    def reachable(self) -> bool:
        return not self.cap * self.size < self.wanted

    def step(self, size: float, slope: float, tolerance: float) -> None:
        """One Newton step from the size reached at ``tilt`` and its derivative."""
        off = size - self.wanted
        if abs(off) <= tolerance * max(self.wanted, 1.0):
            self.done = True
            return
        if off > 0:
            self.high = self.tilt
        else:
            self.low = self.tilt
        new = self.tilt - off / slope if slope > 0 else math.nan
        if not self.low < new < self.high:  # outside the bracket, or no slope: halve or double
            if math.isinf(self.low) or math.isinf(self.high):
                new = self.tilt + math.copysign(max(1.0, abs(self.tilt)), -off)
            else:
                new = (self.low + self.high) / 2
        self.done = new == self.tilt
        self.tilt = new


def read_targets(targets: DataFrame) -> dict[str, Target]:
    rows = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeat").cast("int")).filter("source IS NOT NULL").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    out = {r[0]: Target(r[0], r[1] or 0.0, r[2] if r[2] is not None else 1) for r in rows}
    if len(out) != len(rows) or any(t.share < 0 or t.cap < 0 for t in out.values()):
        raise ValueError("a source has two targets, or a negative share or cap")
    return out


def _rate(tilt, scale, log_cap):
    """The rate of a document of size ``s``; the cap is applied before exp, which thus can't overflow."""
    return F.exp(F.least(tilt * F.col("s") / scale, log_cap))


def _known(spark, targets: list[Target]) -> DataFrame:
    rows = [(t.source, float(t.tilt), float(t.scale), math.log(t.cap), t.cap) for t in targets]
    return F.broadcast(spark.createDataFrame(rows, "source string, tilt double, scale double, log_cap double, cap int"))


def solve(counts: DataFrame, targets: dict[str, Target], tolerance: float = 1e-7, most_steps: int = 60) -> dict[str, Target]:
    """Lambdas for ``counts`` (source, s, n): n documents of size s.  A source that can't reach its target gets its cap.

    Raises if a source that can reach its target hasn't after ``most_steps``.
    """
    spark = counts.sparkSession
    sums = counts.groupBy(F.col("source").isNotNull().alias("known"), "source").agg(F.sum(F.col("s") * F.col("n")).alias("size"), F.sum("n").alias("docs"))
    totals = sums.filter("known").agg(F.sum("size")).first()[0] or 0
    only = spark.createDataFrame([(s,) for s in targets], "source string")
    for r in sums.join(F.broadcast(only), "source").collect():
        targets[r.source].size, targets[r.source].scale = r.size, max(1.0, r.size / r.docs)
    for t in targets.values():
        t.wanted = t.share * totals
        t.done = not t.reachable or t.wanted == 0 or t.size == 0
    for _ in range(most_steps):
        active = [t for t in targets.values() if not t.done]
        if not active:
            break
        rate = _rate(F.col("tilt"), F.col("scale"), F.col("log_cap"))
        at = counts.join(_known(spark, active), "source").withColumn("r", rate)
        free = F.when(F.col("tilt") * F.col("s") / F.col("scale") < F.col("log_cap"), F.col("s") / F.col("scale")).otherwise(0.0)
        used = F.col("s") * F.col("n") * F.col("r")
        for r in at.groupBy("source").agg(F.sum(used).alias("size"), F.sum(used * free).alias("slope")).collect():
            targets[r.source].step(r.size, r.slope, tolerance)
    if left := [t.source for t in targets.values() if not t.done]:
        raise RuntimeError(f"no solution in {most_steps} steps for the sources {left[:5]}")
    return targets


@dataclass
class Mix:
    """``documents`` (key, source, size, rate, copies) and ``targets`` by source."""

    documents: DataFrame
    targets: dict[str, Target]

    def report(self) -> DataFrame:
        """(source, target_share, max_repeat, source_size, reachable, mixed_size, actual_share), one row per target."""
        spark = self.documents.sparkSession
        rows = [(t.source, t.share, t.cap, t.size, t.reachable) for t in self.targets.values()]
        want = spark.createDataFrame(rows, "source string, target_share double, max_repeat int, source_size long, reachable boolean")
        got = self.documents.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("mixed_size"))
        total = got.agg(F.sum("mixed_size").alias("all_size"))
        size = F.coalesce("mixed_size", F.lit(0).cast("long"))
        return want.join(got, "source", "left").crossJoin(F.broadcast(total)).select("source", "target_share", "max_repeat", "source_size", "reachable", size.alias("mixed_size"), F.coalesce(F.try_divide(size, F.col("all_size")), F.lit(0.0)).alias("actual_share"))


def mix(df: DataFrame, key: str, source: str, size: str, targets: DataFrame) -> Mix:
    """How often each document is to be used so that sources reach their target shares.

    ``targets`` has source, target_share and max_repeat.  A source's target is its share of the total
    size of all documents whose source isn't null, listed among the targets or not.  A source whose
    documents, all used ``max_repeat`` times, don't reach its target is used to that cap.  Sources
    without target, and null sources, are not used (copies 0, not listed); nor is a null key; a null or
    negative size counts as 0, and a document of size 0 has rate 1.  A key repeated within a source
    counts once, with its largest size.  Empty tables give an empty mix.

    Rates become copies by systematic rounding: the documents of a source stand in order of size and
    key, and each takes the whole numbers that the running sum of rates passes, so the sizes of any
    run of neighbours are off by less than one document.  The running sum is a blocked prefix sum: a
    source with a third of all rows is cut into blocks.
    """
    if (df.schema[source].dataType.simpleString()) != "string":
        raise ValueError("the source column must be a string")
    s = F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0))
    narrow = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("source"), s.alias("s")).filter("k IS NOT NULL AND source IS NOT NULL")
    sizes = cut(narrow.groupBy("source", "k").agg(F.max("s").alias("s")))
    goals = solve(cut(sizes.groupBy("source", "s").agg(F.count(F.lit(1)).alias("n"))), read_targets(targets))

    usable = [t for t in goals.values() if t.cap > 0 and t.size > 0 and t.wanted > 0]
    rate = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(_rate(F.col("tilt"), F.col("scale"), F.col("log_cap")))
    spark = df.sparkSession
    full = F.broadcast(spark.createDataFrame([(t.source, not t.reachable) for t in usable], "source string, full boolean"))
    rated = sizes.join(_known(spark, usable), "source").join(full, "source").withColumn("rate", rate)
    steps = F.round(F.col("rate") * STEP).cast("long")
    run = prefix_sum(rated.select("k", "source", "s", "rate", "cap"), ["source"], ["s", "k"], steps, "run")
    before = F.col("run") - F.round(F.col("rate") * STEP).cast("long")
    whole = [F.floor((x + STEP // 2) / F.lit(STEP)) for x in (F.col("run"), before)]
    copies = F.least(whole[0] - whole[1], F.col("cap")).cast("int")
    return Mix(run.select(F.col("k").alias(key), "source", F.col("s").alias("size"), "rate", copies.alias("copies")), goals)
