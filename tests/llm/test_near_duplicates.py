import random
import re

import pytest

from quarry.llm import near_duplicates as N
from quarry.llm.components import components


def shingle_set(text, n):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_groups(texts, n, t):
    sets = {k: shingle_set(v, n) for k, v in texts.items()}
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ks = sorted(texts)
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            u = len(sets[a] | sets[b])
            if u and len(sets[a] & sets[b]) >= t * u - 1e-9:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k in ks:
        groups.setdefault(find(k), set()).add(k)
    return {frozenset(g) for g in groups.values()}


def corpus(seed, n=60, copies=5):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = {}
    for i in range(n):
        base = [rnd.choice(words) for _ in range(rnd.randrange(30, 120))]
        out[f"d{i:03}"] = " ".join(base)
        for c in range(rnd.randrange(copies)):
            edited = list(base)
            for _ in range(rnd.randrange(0, 8)):
                j = rnd.randrange(len(edited))
                edited[j : j + rnd.choice([0, 1])] = [rnd.choice(words)] * rnd.choice([0, 1])
            out[f"d{i:03}-{c}"] = " ".join(edited)
    return out


@pytest.mark.parametrize("n,t,pieces", [(3, 0.6, 50_000), (5, 0.8, 1)])
def test_groups_match_brute_force(spark, monkeypatch, n, t, pieces):
    monkeypatch.setattr(N, "BUCKET_ROWS", pieces)  # 1: every recognised bucket is cut into pieces
    monkeypatch.setattr(N, "HOT_SAMPLE", 2)
    texts = corpus(n)
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "id string, body string, c1 string")
    got = {}
    for r in N.near_duplicates(df, "id", "body", signature=N.Signature(words=n, similarity=t)).collect():
        got.setdefault(r.group_id, set()).add(r.id)
        assert r.group_id <= r.id
    assert {frozenset(g) for g in got.values()} == brute_groups(texts, n, t)


def test_edges(spark):
    same = "one two three four five six seven eight"
    rows = [("a", same, 1), ("b", same.upper() + "!", 1), ("c", None, 1), ("d", "", 1), ("e", "too short", 1), ("f", "too short", 1), (None, same, 1), ("g", "other words here entirely unlike the rest of it", 1), ("g", same, 2), ("a", same, 1)]
    df = spark.createDataFrame(rows, "id string, body string, t int").selectExpr("id", "body", "timestamp_seconds(t) AS t", "'x' AS k")
    got = {r.id: (r.group_id, r.group_size) for r in N.near_duplicates(df, "id", "body", "t", N.Signature(words=3, similarity=0.6)).collect()}
    assert got == {"a": ("a", 3), "b": ("a", 3), "g": ("a", 3), "c": ("c", 1), "d": ("d", 1), "e": ("e", 1), "f": ("f", 1)}
    assert N.near_duplicates(df.limit(0), "id", "body", "t").count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 100), (7, 7), (200, None)] + [(300, 301 + i) for i in range(40)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(df, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 100: 50, **dict.fromkeys(range(300, 341), 300)}
    assert components(df.limit(0), "a", "b").count() == 0


def test_every_pair_is_verified_without_a_sketch(spark):
    texts = corpus(8, n=40)
    df = spark.createDataFrame(list(texts.items()), "id string, body string")
    with_all = N.near_duplicates(df, "id", "body", signature=N.Signature(words=3, similarity=0.6, deviations=None)).collect()
    got = {}
    for r in with_all:
        got.setdefault(r.group_id, set()).add(r.id)
    assert {frozenset(g) for g in got.values()} == brute_groups(texts, 3, 0.6)


@pytest.mark.parametrize("high", [2, 7, 50])
def test_cut_buckets_give_the_same_pairs(spark, high):
    rows = [(v, n, n % 3) for v in range(3) for n in range(40 * (v + 1))]
    df = spark.createDataFrame(rows, "v long, n long, g long")
    pairs = [{tuple(sorted(r)) for r in N._across(df, 2, high, cut_up).collect()} for cut_up in (False, True)]
    assert pairs[0] == pairs[1] and pairs[0]
