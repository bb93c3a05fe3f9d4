import random

from quarry.llm.ranking import leximin, ranking, top

SCHEMA = "q string, d string, a double, b double, pool string, item int"


def brute(rows):
    pools = {}
    for q, d, a, b in rows:
        if q is None or d is None:
            continue
        best = pools.setdefault(q, {}).setdefault(d, [None, None])
        for i, v in enumerate((a, b)):
            if v is not None and v == v and (best[i] is None or v > best[i]):
                best[i] = v
    out = {}
    for q, docs in pools.items():
        def share(i, v):
            low = lambda x: float("-inf") if x is None else x
            below = sum((docs[o][i] is None and v is not None) or (docs[o][i] is not None and v is not None and docs[o][i] < v) for o in docs)
            return below / max(1, len(docs) - 1)
        stood = {d: sorted(share(i, v) for i, v in enumerate(s)) for d, s in docs.items()}
        out[q] = sorted(docs, key=lambda d: ([-x for x in stood[d]], d))
    return out


def test_ranking_matches_brute_force(spark):
    rnd = random.Random(5)
    value = lambda: rnd.choice([None, float("nan"), float("inf"), 0.0, -0.0, *[float(rnd.randrange(6)) for _ in range(6)]])
    rows = [(rnd.choice(["p", "q", "r", None]), rnd.choice([f"d{i}" for i in range(25)] + [None]), value(), value()) for _ in range(300)] + [("one", "x", None, None)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    want = brute(rows)
    got = {}
    for r in sorted(ranking(df, "q", "d", ["a", "b"]).collect(), key=lambda r: r.place):
        got.setdefault(r.q, []).append(r.d)
    assert got == want
    first = {}
    for r in sorted(top(df, "q", "d", ["a", "b"], 5).collect(), key=lambda r: r.place):
        first.setdefault(r.q, []).append(r.d)
    assert first == {q: d[:5] for q, d in want.items()}


def test_neither_scale_dominates(spark):
    rows = [("q", "both", 900.0, 0.9), ("q", "big", 1e9, 0.1), ("q", "fine", 10.0, 0.99), ("q", "low", 5.0, 0.0)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    assert [r.d for r in sorted(ranking(df, "q", "d", ["a", "b"]).collect(), key=lambda r: r.place)][0] == "both"
    assert leximin(df.limit(0), "q", "d", ["a", "b"]).count() == 0


def test_a_large_pool_with_one_frequent_score_spans_blocks(spark):
    rnd = random.Random(9)
    rows = [("hot", f"d{i:05}", None if rnd.random() < 0.4 else float(rnd.randrange(4)), 1.0 if rnd.random() < 0.7 else rnd.random()) for i in range(900)]
    rows += [(f"p{i}", f"d{j}", rnd.random(), rnd.choice([None, 0.5])) for i in range(40) for j in range(3)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    got = {}
    for r in sorted(ranking(df, "q", "d", ["a", "b"]).collect(), key=lambda r: r.place):
        got.setdefault(r.q, []).append(r.d)
    assert got == brute(rows)
