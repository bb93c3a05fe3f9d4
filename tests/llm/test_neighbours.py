import numpy as np

from quarry.llm.neighbours import Scan, nearest, scan_list


def brute(vectors, k):
    ids = list(vectors)
    x = np.array([vectors[i] for i in ids], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {i: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-s[n, j], ids[j]))[:k]] for n, i in enumerate(ids)}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.random((20, 48))
    vectors = {i: (centres[i % 20] + 0.3 * rng.random(48)).astype(np.float32) for i in range(1500)}
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in vectors.items()], "id long, v array<float>, k string")
    got = {}
    for r in nearest(df, "id", "v", 48, Scan(k=5)).collect():
        got.setdefault(r.id, []).append((r.place, r.neighbour))
    want = brute(vectors, 5)
    hits = sum(len({n for _, n in got[i]} & set(want[i])) for i in want)
    assert all(len(got[i]) == 5 for i in want)
    assert hits / (5 * len(want)) >= 0.97


def test_abandoning_keeps_exact_distances():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(700)
    d, found = scan_list(x, ids, x, ids, Scan(k=3, epsilon=8.0))
    full = 2 - 2 * (x @ x.T)
    np.fill_diagonal(full, np.inf)
    assert (np.sort(full, axis=1)[:, :3] - d < 1e-4).all() and (found != ids[:, None]).all()


def test_edges(spark):
    e = [float("nan"), float("inf")]
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0]), (7, [e[0], 1.0]), (8, [e[1], 1.0]), (None, [1.0, 1.0]), (9, [1.0, None])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.id, r.place): r.neighbour for r in nearest(df, "id", "v", 2, Scan(k=2)).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 2, (3, 2): 1}
    assert nearest(df.limit(0), "id", "v", 2).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 1.0, 0.0]) for i in range(40)] + [(100, [0.0, 1.0, 1.0])]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v", 3, Scan(k=3)).collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert all(sorted(got[i]) == [j for j in range(4) if j != i][:3] for i in range(40))
    assert sorted(got[100]) == [0, 1, 2]


def test_lists_within_lists(spark, monkeypatch):
    """Beyond the bound of one quantiser lists go on growing in number, and recall holds; large lists are cut."""
    from quarry.llm import neighbours as module

    rng = np.random.default_rng(4)
    centres = rng.random((40, 32))
    vectors = {i: (centres[i % 40] + 0.4 * rng.random(32)).astype(np.float32) for i in range(3000)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, v array<float>")
    want = brute(vectors, 5)
    monkeypatch.setattr(module, "MOST_LISTS", 16)
    monkeypatch.setattr(module, "UNIT_ROWS", 60)
    seen = []
    deep = module._two_levels
    monkeypatch.setattr(module, "_two_levels", lambda *a: seen.append(deep(*a)) or seen[-1])
    got = {}
    for r in module.nearest(df, "id", "v", 32, Scan(k=5, per_list=24, slack=0.3)).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert sum(len(got[i] & set(want[i])) for i in want) >= 0.95 * 5 * len(want)
    spread = seen[0].filter("cand").selectExpr("u >> 32 AS list", "k").distinct()
    assert spread.select("list").distinct().count() > 3 * 16
    assert spread.count() == 3000  # each vector lies in one list


def test_parts_of_a_list_meet_all_parts():
    from quarry.llm.neighbours import _units

    ks = np.arange(50, dtype=np.int64)
    row, unit, cand, query = _units(np.arange(50), np.zeros(50, dtype=np.int64), np.ones(50, dtype=bool), ks, np.array([3]), 0)
    met = {(a, b) for u in set(unit.tolist()) for a in row[(unit == u) & cand] for b in row[(unit == u) & query]}
    assert met == {(a, b) for a in range(50) for b in range(50)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_holds_all_that_probes_a_list(spark, monkeypatch):
    """Rows reach quantisers and lists in batches; only the bounded samples, of which quantisers are fitted, are groups."""
    from quarry.llm import neighbours as module

    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.random(16).tolist()) for i in range(600)], "id long, v array<float>")
    assert "InPandas" in plan(nearest(df, "id", "v", 16)) and "GroupsInPandas" not in plan(nearest(df, "id", "v", 16))
    monkeypatch.setattr(module, "MOST_LISTS", 4)
    deep = plan(module.nearest(df, "id", "v", 16, Scan(per_list=20)))
    assert "CoGroupsInPandas" not in deep and deep.count("FlatMapGroupsInPandas") == 1


def test_batches_may_end_anywhere(spark, monkeypatch):
    from quarry.llm import neighbours as module

    monkeypatch.setattr(module, "MOST_LISTS", 4)
    monkeypatch.setattr(module, "UNIT_ROWS", 60)
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, rng.random(16).tolist()) for i in range(500)], "id long, v array<float>")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    got, usual = [], spark.conf.get(name)
    try:
        for rows in ("7", "10000"):
            spark.conf.set(name, rows)
            got.append(sorted((r.id, r.place, r.neighbour) for r in module.nearest(df, "id", "v", 16, Scan(k=4, per_list=20)).collect()))
    finally:
        spark.conf.set(name, usual)
    assert len(got[0]) == 4 * 500 and got[0] == got[1]


def test_rows_leave_in_small_frames():
    """Also rows that go to lists cut into many parts; and each list's rows still meet."""
    from quarry.llm.neighbours import EMITTED, _spread

    ks, unit = np.arange(2000, dtype=np.int64), np.zeros((2000, 4), dtype=np.float32)
    row, lists = np.repeat(np.arange(2000), 2), np.tile([0, 1], 2000)
    frames = list(_spread(unit, ks, row, lists, lists == 0, np.array([20, 30]), np.array([5, 9])))
    assert max(map(len, frames)) <= EMITTED + 60 and sum(map(len, frames)) == 2000 * (2 * 20 - 1 + 30)


def test_keys_of_any_pattern_are_spread():
    from quarry.llm.neighbours import _draw

    for ks in (np.arange(3000) << 32, np.arange(3000) * -128, np.arange(3000)):
        counts = np.bincount(_draw(ks.astype(np.int64), 1) % 3, minlength=3)
        assert counts.min() > 850


def test_lists_within_lists_are_probed_as_lists_of_one_level(spark, monkeypatch):
    """At most ``most_probes`` in all, the own list among them, and none for a coarse list as such."""
    from quarry.llm import neighbours as module

    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, rng.random(24).tolist()) for i in range(1500)], "id long, v array<float>")
    monkeypatch.setattr(module, "MOST_LISTS", 8)
    seen, deep = [], module._two_levels
    monkeypatch.setattr(module, "_two_levels", lambda *a: seen.append(deep(*a)) or seen[-1])
    module.nearest(df, "id", "v", 24, Scan(k=3, per_list=24, most_probes=4, slack=5.0))
    rows = [(r.k, r.u >> 32, r.cand) for r in seen[0].collect()]
    assert sorted(k for k, _, cand in rows if cand) == list(range(1500))
    assert len(set(rows)) == len(rows) and max(np.bincount([k for k, _, _ in rows])) <= 4
