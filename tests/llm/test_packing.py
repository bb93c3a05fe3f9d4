import random

import numpy as np

from quarry.llm.packing import pack, sum_of_squares
from quarry.llm.tokens import n_tokens, sized, stretches


def brute_sum_of_squares(sizes, capacity):
    count = [0] * (capacity + 1)
    levels = []
    for s in sizes:
        best = None
        for h in range(capacity - s + 1):
            if h and not count[h]:
                continue
            after = list(count)
            if h:
                after[h] -= 1
            if h + s < capacity:
                after[h + s] += 1
            cost = sum(c * c for c in after[1:capacity])
            if best is None or cost < best[0] or (cost == best[0] and h > best[1]):
                best = (cost, h, after)
        count = best[2]
        levels.append(best[1])
    return levels


def test_levels_minimise_the_sum_of_squares():
    rnd = random.Random(4)
    for _ in range(20):
        capacity = rnd.randrange(5, 25)
        sizes = [rnd.randrange(1, capacity + 1) for _ in range(80)]
        bins, levels = sum_of_squares(np.array(sizes), capacity)
        assert levels.tolist() == brute_sum_of_squares(sizes, capacity)
        fill = {}
        for b, h, s in zip(bins.tolist(), levels.tolist(), sizes):
            assert fill.get(b, 0) == h
            fill[b] = h + s
        assert max(fill.values()) <= capacity


def check(rows, capacity, sizes):
    pieces, fill = {}, {}
    for r in rows:
        pieces.setdefault(r.id, []).append((r.piece, r.size_start, r.size_end))
        fill.setdefault(r.container, []).append((r.container_start, r.container_start + r.size_end - r.size_start))
    assert set(pieces) == set(sizes)
    for i, parts in pieces.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert parts[0][1] == 0 and parts[-1][2] == sizes[i] and all(a[2] == b[1] for a, b in zip(parts, parts[1:]))
        assert len(parts) == max(1, -(-sizes[i] // capacity))
    for spans in fill.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    return sum(s[-1][1] for s in fill.values()) / (capacity * len(fill))


def test_operator(spark):
    rnd = random.Random(6)
    sizes = {i: rnd.choice([rnd.randrange(1, 60), rnd.randrange(1, 200), 1000]) for i in range(3000)}
    rows = [(i, s, "x") for i, s in sizes.items()] + [(5, 1, "x"), (7, sizes[7], "x"), (9999, 0, "x"), (9998, None, "x"), (9997, -4, "x"), (None, 5, "x")]
    df = spark.createDataFrame(rows, "id long, n long, container string")
    assert check(pack(df, "id", "n", 256).collect(), 256, sizes) > 0.97
    assert check(pack(df, "id", "n", 256, group_items=400).collect(), 256, sizes) > 0.9
    again = {tuple(r) for r in pack(df.repartition(7), "id", "n", 256).collect()}
    assert again == {tuple(r) for r in pack(df, "id", "n", 256).collect()}
    assert pack(df.limit(0), "id", "n", 256).count() == 0


def test_tokens(spark):
    assert n_tokens("") == 0
    text = "Some words, 日本語 and  blanks.\n" * 3000
    assert sum(map(len, stretches(text, 1000))) == len(text) and "".join(stretches(text, 1000)) == text
    for run in (" " * 150_000, "a" * 150_000, "\n \t" * 50_000):
        assert n_tokens(run) > 0
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "id long, text string")
    assert {r.id: r.n for r in sized(df, "text", "n").collect()} == {1: 2, 2: 0, 3: 0}


def test_unfinished_containers_are_packed_again(spark):
    rnd = random.Random(8)
    sizes = {i: rnd.randrange(1, 90) for i in range(6000)}
    df = spark.createDataFrame(list(sizes.items()), "id long, n long")
    assert check(pack(df, "id", "n", 256, group_items=500).collect(), 256, sizes) > 0.985
