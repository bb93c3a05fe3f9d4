import math
import random

import pytest

from quarry.llm.mixing import mix

TARGETS = "source string, target_share double, max_repeat int"


def documents(spark, n=4000):
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        source = rnd.choice(["big"] * 6 + ["mid"] * 3 + ["small", None, "unlisted"])
        rows.append((i, source, rnd.randrange(1, 40) if source != "mid" else int(rnd.paretovariate(1.2) * 10), "x"))
    rows += [(1, rows[1][1], 1, "x"), (n, "big", None, "x"), (n + 1, "big", -3, "x"), (None, "big", 9, "x")]
    return rows, spark.createDataFrame(rows, "id long, source string, size long, tilt string")


def test_shares_are_reached(spark):
    rows, df = documents(spark)
    targets = spark.createDataFrame([("big", 0.3, 3), ("mid", 0.5, 2), ("small", 0.3, 2), ("none", 0.1, 4)], TARGETS)
    m = mix(df, "id", "source", "size", targets)
    got = m.documents.collect()
    total = sum(s for i, src, s, _ in {r[0]: r for r in rows[:4000]}.values() if src)
    sizes = {src: sum(s for i, x, s, _ in rows[:4000] if x == src) for src in ("big", "mid", "small")}
    for src, share, cap in (("big", 0.3, 3), ("mid", 0.5, 2), ("small", 0.3, 2)):
        mine = [r for r in got if r.source == src]
        mixed, largest = sum(r.size * r.copies for r in mine), max(r.size for r in mine)
        assert all(0 <= r.copies <= cap and abs(r.copies - r.rate) < 1 + 1e-6 for r in mine)
        if cap * sizes[src] < share * total:
            assert mixed == cap * sizes[src] and src == "small"
        else:
            assert abs(mixed - share * total) <= 2 * largest
            # The rates of a source are one exponential of size, up to the cap.
            tilts = {round(math.log(r.rate) / r.size, 6) for r in mine if r.size and r.rate < cap - 1e-9}
            assert len(tilts) == 1
    report = {r.source: r for r in m.report().collect()}
    assert not report["small"].reachable and not report["none"].reachable and report["big"].reachable
    assert report["none"].source_size == 0 and report["none"].actual_share == 0
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)


def test_empty_tables(spark):
    _, df = documents(spark, 50)
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    assert mix(df.limit(0), "id", "source", "size", targets).documents.count() == 0
    assert mix(df, "id", "source", "size", targets.limit(0)).documents.count() == 0
    assert [r.reachable for r in mix(df.limit(0), "id", "source", "size", targets).report().collect()] == [True]


def test_bad_targets(spark):
    _, df = documents(spark, 50)
    with pytest.raises(ValueError):
        mix(df, "id", "source", "size", spark.createDataFrame([("big", 0.5, 1), ("big", 0.5, 2)], TARGETS))


def test_an_unsolved_source_is_an_error(spark):
    from pyspark.sql import functions as F

    from quarry.llm import mixing

    _, df = documents(spark, 50)
    counts = df.filter("source IS NOT NULL AND size > 0").groupBy("source", F.col("size").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    with pytest.raises(RuntimeError):
        mixing.solve(counts, {"big": mixing.Target("big", 0.3, 3)}, most_steps=1)
