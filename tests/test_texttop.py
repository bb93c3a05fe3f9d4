"""The best documents of many searches equal those of all scores, and no row stands for a (query, document) pair."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import textindex, texttop
from quarry.plans.text_queries import QUERIES


def _brute(queries, postings, limit):
    """query -> the best (score, document)."""
    got = {}
    for q, terms in queries.items():
        scores = {}
        for d, t, p in postings:
            if t in terms:
                scores[d] = scores.get(d, 0.0) + p * terms.count(t)
        got[q] = sorted((-int(np.floor(s * 1e9 + 0.5)), d) for d, s in scores.items())[:limit]
    return got


@pytest.mark.parametrize("chunk, read, room, most, top", [(16_384, 1_000_000, 96 << 20, 128, 60_000), (7, 60, 96 << 20, 128, 60_000), (7, 60, 28, 128, 60_000), (50, 10, 1, 2, 60_000), (13, 200, 200, 3, 40)])
def test_best_documents_equal_brute_force(monkeypatch, chunk, read, room, most, top):
    """Chunks, rows that don't fit, queries scored whole and coarse bounds change nothing; ties go to the lesser document."""
    for name, value in zip(("CHUNK_DOCS", "READ_POSTINGS", "ROW_BYTES", "MOST_BOUNDED", "_TOP", "PAIRS"), (chunk, read, room, most, top, 20)):
        monkeypatch.setattr(texttop, name, value)
    rng = random.Random(chunk + room)
    queries = {f"q{i}": [rng.choice([3, 5, 8, 900, 7_000_000_000, 11, 12, 13]) for _ in range(rng.randint(1, 6))] for i in range(60)}
    codes = [3, 5, 8, 900, 7_000_000_000, 11, 12]  # nobody's term: 77; no document's: 13
    postings = [(f"d{d:03}", t, rng.choice([0.25, 0.5, 1.0, rng.random() * 9, 1e-7])) for d in range(200) for t in rng.sample([*codes, 77], rng.randint(1, 7))]
    doc, code, part = (pa.array(x) for x in zip(*postings))
    batches = pa.table({"doc": doc, "code": code, "part": part}).to_batches(max_chunksize=33)
    sent = texttop.Queries(pa.array(list(queries)), pa.array(list(queries.values()), pa.list_(pa.int64())))
    got = {}
    for b in texttop.best_documents(iter(batches), sent, 4, 9):
        for r in b.to_pylist():
            got.setdefault(r["query_id"], []).append((-round(r["score"] * 1e9), r["doc"]))
    assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in _brute(queries, postings, 4).items() if x}


def test_groups_without_rows_give_none():
    sent = texttop.Queries(pa.array(["q"]), pa.array([[1]]))
    assert list(texttop.best_documents(iter([]), sent, 4, 9)) == []
    other = pa.record_batch({"doc": ["d"], "code": [2], "part": [1.0]})
    assert list(texttop.best_documents(iter([other]), sent, 4, 9)) == []


@pytest.mark.parametrize("few, slice_terms, every", [(200_000, 2_000_000, False), (0, 40, True)])
def test_top_equals_top_of_all_scores(spark, monkeypatch, few, slice_terms, every):
    """Vocabularies that are broadcast or joined, queries at once or in slices; repeated ids, null, empty and equal texts."""
    monkeypatch.setattr(textindex, "FEW_QUERY_TERMS", few)
    monkeypatch.setattr(textindex, "SLICE_TERMS", slice_terms)
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "on", "zeta9", "Ünd", "x"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, text(rng.randint(1, 9))) for i in range(150)] + [(200, None), (201, ""), (202, "the"), (202, "the"), (None, "alpha beta"), (203, "alpha alpha"), (204, "alpha alpha")]
    asked = [(f"q{i}", text(rng.randint(1, 4))) for i in range(40)] + [("q1", "alpha beta"), (None, "gamma"), ("none", "nowhere"), ("empty", ""), ("long", " ".join(f"w{i}" for i in range(300)) + " alpha beta")]
    d, q = spark.createDataFrame(docs, "d int, t string"), spark.createDataFrame(asked, "query_id string, text string")
    want = textindex.top(textindex.bm25(d, "d", F.col("t"), q, every=every), 5)
    got = textindex.bm25_top(d, "d", F.col("t"), q, 5, every=every)
    assert got.columns == want.columns
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(got) == rows(want) and got.count() > 150
    assert textindex.bm25_top(d, "d", F.col("t"), q.limit(0), 5).count() == 0 and textindex.bm25_top(d.limit(0), "d", F.col("t"), q, 5).count() == 0


def _most_rows(plan) -> int:
    """The largest number of rows that a node of a plan that has run put out."""
    inner = [getattr(plan, m)() for m in ("finalPhysicalPlan", "plan") if m in dir(plan)]
    children = plan.children()
    rows = plan.metrics().get("numOutputRows")
    return max([rows.get().value() if rows.isDefined() else 0, *map(_most_rows, [*inner, *(children.apply(i) for i in range(children.size()))])])


def test_title_queries_make_no_row_for_every_pair(spark, tmp_path):
    """300 titles that all 400 documents match: 240,000 (query, document, term) rows before."""
    spark.createDataFrame([(f"d{i:03}", f"alpha beta g{i}") for i in range(400)], "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(f"a{i:03}", "Alpha beta", f"b{i}") for i in range(300)], "doc_id string, title string, body string").write.parquet(f"{tmp_path}/article.parquet")
    found = QUERIES["bm25_title_queries"](spark, str(tmp_path))
    rows = found.collect()
    assert {(r.query_id, r.rank): r.doc_id for r in rows} == {(f"a{i:03}", k + 1): f"d{k:03}" for i in range(300) for k in range(5)}
    assert 1500 <= _most_rows(found._jdf.queryExecution().executedPlan()) <= 10_000
