import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.operators.intervals import OPEN_END, periods_and_gaps
from quarry.operators.prefix import prefix_sum
from pyspark.sql import functions as F

SCHEMA = "who string, s long, e long, span string"


def brute(rows):
    by = {}
    for who, s, e, *_ in rows:
        if s is not None and (e is None or e > s):
            by.setdefault(who, []).append((s, OPEN_END if e is None else e))
    out = set()
    for who, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(who, "period", s, e) for s, e in merged}
        out |= {(who, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, rows, partitions=4):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = [tuple(r) for r in periods_and_gaps(df, ["who"], "s", "e", partitions).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_small_cases(spark):
    rows = [
        ("a", 1, 5), ("a", 2, 3), ("a", 5, 7), ("a", 8, 9), ("a", 8, 9), ("a", 20, None),  # nested, touching, repeated, open
        ("b", 5, 5), ("b", 6, 4), ("b", None, 9),  # empty, inverted, no start: nothing
        (None, 1, 2), (None, 4, 6), ("c", 3, None),
    ]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_one_entity_over_many_blocks(spark):
    rnd = random.Random(3)
    rows = [("hot", s := rnd.randrange(4000), None if rnd.random() < 0.001 and s > 3900 else s + rnd.randrange(1, 4)) for _ in range(1500)]
    rows += [("long", 0, 5000), ("long", 6000, 7000)] + [("hot", 5000 + 10 * i, 5004 + 10 * i) for i in range(300)]
    for partitions in (1, 7, 23):
        assert run(spark, rows, partitions) == brute(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["x", "y"]), st.integers(0, 30) | st.none(), st.integers(0, 32) | st.none()), max_size=40))
def test_against_brute_force(spark, rows):
    assert run(spark, rows, 5) == brute(rows)


def test_prefix_sum_matches_a_window(spark):
    df = spark.createDataFrame([("g" if i % 3 else None, i, float(i % 5) if i % 4 else None, "x") for i in range(400)], "k string, o int, v double, block string")
    got = {(r.k, r.o): r.t for r in prefix_sum(df, ["k"], ["o"], F.col("v"), "t", 9).collect()}
    run_sum, want = {}, {}
    for i in range(400):
        k = "g" if i % 3 else None
        run_sum[k] = run_sum.get(k, 0) + (i % 5 if i % 4 else 0)
        want[(k, i)] = run_sum[k]
    assert got == want


def test_following_matches_a_window(spark):
    from quarry.operators.prefix import following

    rows = [(["g", None, "h"][i % 7 % 3], i, i * 2 if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    by = {}
    for k, o, v in rows:
        by.setdefault(k, []).append((o, v))
    want = {(k, a[0]): b for k, r in by.items() for a, b in zip(r, r[1:] + [(None, None)])}
    for partitions in (1, 11):
        got = {(r.k, r.o): (r.next_o, r.next_v) for r in following(df, ["k"], ["o"], ["o", "v"], partitions=partitions).collect()}
        assert got == want
