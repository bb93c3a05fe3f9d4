"""The methods of the problems whose found rows a plain rule could give too: each test fails if the method is taken out."""

import os
import re
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

from quarry.llm.registry import everything  # noqa: E402
from quarry.llm.splitting import LEVELS, _separators  # noqa: E402
from quarry.llm.tokens import encoding, n_tokens, stretches, VOCABULARY  # noqa: E402

QUERIES, _ = everything()


def column(name, *columns):
    return list(zip(*(pq.read_table(f"{SF}/{name}.parquet", columns=list(columns))[c].to_pylist() for c in columns)))


def test_methods_are_registered_first():
    first = {}
    for name in QUERIES:
        first.setdefault(name.split("_")[0], name)
    assert {p: n for p, n in first.items() if p in ("p1", "p3", "p6", "p7")} == {p: f"{p}_method" for p in ("p1", "p3", "p6", "p7")}


def test_p1_takes_the_strongest_rightmost_cut(spark):
    bodies = {}
    for k, body, at in sorted(column("article", "doc_id", "body", "ingested_at"), key=lambda r: r[2]):
        bodies[k] = body
    got = defaultdict(list)
    for r in QUERIES["p1_method"](spark, SF).collect():
        got[r.doc_id].append(r)
    assert set(got) == {k for k, b in bodies.items() if b and len(b) > 6000}
    weaker = 0
    for k, pieces in got.items():
        pieces.sort(key=lambda r: r.piece)
        cuts = [(e, s) for _, e, s in _separators(bodies[k])]
        assert pieces[-1].piece_end == len(bodies[k])
        for a, b in zip(pieces, pieces[1:]):
            assert b.piece_start == a.piece_end - 300 and len(a.piece_text) <= 6000
            strength = LEVELS.index(a.cut)
            inside = [(s, e) for e, s in cuts if a.piece_start + 3000 <= e <= a.piece_start + 6000]
            best = max(inside, default=(0, -1))
            if best[0] >= max(1, LEVELS.index(a.boundary)):
                assert (strength, a.piece_end) == best
            else:
                weaker += 1
                wide = max([(s, e) for e, s in cuts if a.piece_start + 300 < e <= a.piece_start + 6000], default=(0, a.piece_start + 6000))
                assert (strength, a.piece_end) == (wide if wide[0] > best[0] else best if best[0] else wide)
    assert sum(len(p) - 1 for p in got.values()) > 2 * weaker


def test_p3_single_bits_find_close_copies_and_nothing_else(spark):
    bodies = {}
    for k, body, at in sorted(column("article", "doc_id", "body", "ingested_at"), key=lambda r: r[2]):
        bodies[k] = body or ""
    words = {k: re.findall(r"[^\W_]+", b.lower()) for k, b in bodies.items()}
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, w in words.items()}
    group = {r.doc_id: r.group_id for r in QUERIES["p3_method"](spark, SF).collect()}
    whole = {r.doc_id: r.group_id for r in QUERIES["p3_groups"](spark, SF).collect()}
    assert set(group) == set(whole) == set(bodies)
    together = defaultdict(set)
    for k, g in group.items():
        together[g].add(whole[k])
    assert all(len(w) == 1 for w in together.values())
    ks = sorted(k for k in sets if sets[k])
    close = [(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b])]
    assert close and sum(group[a] == group[b] for a, b in close) >= 0.95 * len(close)


def test_p6_fills_containers(spark):
    sizes = {k: n_tokens(t or "") for k, t in column("documents", "doc_id", "text")}
    fill, parts = defaultdict(int), defaultdict(int)
    for r in QUERIES["p6_method"](spark, SF).collect():
        fill[r.container] += r.size_end - r.size_start
        parts[r.doc_id] += 1
    assert max(fill.values()) <= 4096 and sum(fill.values()) == sum(sizes.values())
    assert all(parts[k] == -(-n // 4096) for k, n in sizes.items())
    assert len(fill) <= sum(sizes.values()) / 4096 * 1.02 + 1


def test_p7_reaches_the_shares(spark):
    sizes, total, largest = defaultdict(int), 0, defaultdict(int)
    for s, t in column("documents", "source", "text"):
        if s is not None:
            n = n_tokens(t or "")
            sizes[s] += n
            total += n
            largest[s] = max(largest[s], n)
    mixed, copies = defaultdict(int), defaultdict(int)
    for r in QUERIES["p7_method"](spark, SF).collect():
        mixed[r.source] += r.size * r.copies
        copies[r.source] = max(copies[r.source], r.copies)
    for s, share, most in column("mix_target", "source", "target_share", "max_repeat"):
        assert copies[s] <= most
        if most * sizes[s] < share * total:
            assert mixed[s] == most * sizes[s]
        else:
            assert abs(mixed[s] - share * total) <= 2 * largest[s]


def test_stretches_have_the_tokens_of_the_whole_text():
    encode = encoding(VOCABULARY).encode_ordinary
    texts = ["abc123," * 3000, "a" * 30_000, "it's " * 4000, "日本語。テスト、" * 2000, ("word  \n\n " * 3000), "x'll!!'s" * 3000, " " * 5000 + "end" * 4000, "1" * 9000 + "a" * 9000]
    for text in texts:
        assert "".join(stretches(text, 100)) == text
        assert sum(len(encode(s)) for s in stretches(text, 100)) == len(encode(text))
    assert max(map(len, stretches("ab, " * 10_000, 100))) < 200
