"""The problems' queries on the smallest tables against SQL or a plain computation."""

import os
import re
import sys
from pathlib import Path

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

from quarry.llm.registry import everything  # noqa: E402

QUERIES, SQL = everything()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(spark, name):
    return [tuple(r) for r in QUERIES[name](spark, SF).collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    cur = duck.execute(SQL[name])
    order = [[d[0] for d in cur.description].index(c) for c in QUERIES[name](spark, SF).columns]
    assert sorted(rows(spark, name)) == sorted(tuple(r[i] for i in order) for r in cur.fetchall())


def test_p2_recall(spark, duck):
    found = duck.execute("SELECT vec_id, any_value(embedding) FROM embshim_vector WHERE len(embedding) = 384 GROUP BY vec_id").fetchall()
    usable = {i: np.array(v, dtype=np.float64) for i, v in found if None not in v and np.isfinite(np.array(v, dtype=np.float64)).all() and any(v)}
    ids, x = np.array(list(usable)), np.stack(list(usable.values()))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = {tuple(sorted((int(ids[a]), int(ids[b])))) for a in range(len(ids)) for b in np.argsort(-s[a], kind="stable")[:10]}
    got = set(rows(spark, "p2_found"))
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_p3_pairs(spark, duck):
    bodies = dict(duck.execute("SELECT doc_id, any_value(body) FROM article GROUP BY doc_id").fetchall())
    sets = {}
    for k, text in bodies.items():
        w = re.findall(r"[^\W_]+", (text or "").lower())
        sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    group = {k: k for k in sets}
    ks = sorted(sets)
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.6 * (len(sets[a]) + len(sets[b]) - both) - 1e-9 and group[a] != group[b]:
                old, new = group[b], group[a]
                group = {k: new if g == old else g for k, g in group.items()}
    want = [(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if group[a] == group[b]]
    assert sorted(rows(spark, "p3_found")) == want


def test_p6_and_p7(spark, duck):
    from quarry.llm.tokens import n_tokens

    docs = [(i, s, n_tokens(t or "")) for i, s, t in duck.execute("SELECT doc_id, source, text FROM documents").fetchall()]
    assert sorted(rows(spark, "p6_found")) == sorted((i,) for i, _, n in docs if n > 4096)
    size, total = {}, sum(n for _, s, n in docs if s is not None)
    for _, s, n in docs:
        size[s] = size.get(s, 0) + n
    targets = duck.execute("SELECT source, target_share, max_repeat FROM mix_target").fetchall()
    assert sorted(rows(spark, "p7_found")) == sorted((s,) for s, share, most in targets if most * size.get(s, 0) < share * total)
    packed = QUERIES["p6_packing"](spark, SF).collect()
    assert sum(r.size_end - r.size_start for r in packed) == sum(n for *_, n in docs)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_schema_and_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


FOUND = {"p1_found": ["doc_id", "boundary"], "p2_found": ["vec_id_a", "vec_id_b"], "p3_found": ["doc_id_a", "doc_id_b"], "p5_found": ["qid", "doc_id"], "p6_found": ["doc_id"], "p7_found": ["source"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_of_found(spark, name):
    assert QUERIES[name](spark, SF).columns == FOUND[name]
