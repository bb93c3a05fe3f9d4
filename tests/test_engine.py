import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine, hashing_embedder
from quarry.errors import IllegalTransition, InvalidArgument, InvalidFilter, ProjectionRejected, UnknownCollection, WriteRejected
from quarry.operators.filters import Filter, Json
from quarry.operators.projections import Projection
from quarry.operators.views import ReadView


def node(i, body, kind="note", **more):
    return {"kind": kind, "body": body, "source_id": f"src{i % 2}", "logical_id": f"n{i}", **more}


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"), now=lambda: 1000, embedder=hashing_embedder(32), dim=32)
    e.write([node(0, "alpha beta"), node(1, "beta gamma"), node(2, "delta", valid_from=2000), node(3, "old alpha", state="pending")], [{"kind": "knows", "from": "n0", "to": "n1", "source_id": "src0", "body": "alpha knows gamma"}, {"kind": "knows", "from": "n1", "to": "n9", "source_id": "src1", "t_invalid": 500}])
    return e


def test_write_and_read(engine, spark):
    assert engine.open_report()["cursor"] == 6
    assert [r.body for r in engine.get_many(["n1", "nope", "n0", "n3", "n2"]).collect()] == ["beta gamma", None, "alpha beta", None, None]
    assert engine.get("n2", ReadView(valid_as_of=2500)).count() == 1
    assert engine.get("n3", ReadView(include_inactive=True)).count() == 1
    r = engine.write([node(0, "alpha omega")])
    assert r["cursor"] == 7 and engine.get("n0").first().body == "alpha omega"
    history = {x.write_cursor: x.superseded_at for x in engine.table("nodes").filter("logical_id = 'n0'").collect()}
    assert history == {1: 7, 7: None}
    assert Engine(spark, engine.path).get("n0").first().body == "alpha omega"  # a fresh one sees the commit


def test_dangling_is_reported(engine):
    assert engine.write(edges=[{"kind": "k", "from": "n0", "to": "ghost", "source_id": "s"}, {"kind": "k", "from": "x", "to": "y", "source_id": "s"}])["dangling"] == 3


@pytest.mark.parametrize("bad", [{"kind": "k", "body": "b"}, {"kind": "k", "body": "b", "source_id": "_x"}, {"kind": "", "body": "b", "source_id": "s"}, {"kind": "k", "body": "b", "source_id": "s", "valid_from": 5, "valid_until": 5}, {"kind": "k", "body": "b", "source_id": "s", "state": "gone"}, {"kind": "k", "body": "b", "source_id": "s", "valid_from": True}, {"kind": "k", "source_id": "s", "what": 1}])
def test_a_bad_row_rejects_the_batch(engine, bad):
    with pytest.raises(WriteRejected):
        engine.write([node(7, "fine"), bad])
    assert engine.get("n7").count() == 0


def test_lifecycle(engine):
    engine.transition("n3", "active")
    assert engine.get("n3").count() == 1
    with pytest.raises(IllegalTransition):
        engine.transition("n3", "pending")
    with pytest.raises(IllegalTransition):
        engine.purge("n0")
    engine.transition("n0", "deleted", "unwanted")
    engine.purge("n0")
    engine.purge("n0")  # again: nothing
    assert engine.table("nodes").filter("logical_id = 'n0'").count() == 0
    assert engine.table("edges").filter("from_id = 'n0' OR to_id = 'n0'").count() == 0


def test_erasure_leaves_no_bytes(engine):
    engine.write([node(4, "SECRETWORD", valid_until=None)])
    report = engine.erase_source("src0")
    assert report["nodes"] == 3 and report["edges"] == 1
    assert engine.erase_source("src0")["nodes"] == 0
    assert not any(b"SECRETWORD" in p.read_bytes() or b"alpha beta" in p.read_bytes() for p in Path(engine.path).rglob("*.parquet"))
    assert {r.logical_id for r in engine.table("nodes").collect()} == {"n1", "n3"}


def test_op_store(engine):
    engine.configure("log", "append_only_log", {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 0}}})
    engine.configure("last", "latest_state")
    engine.put("log", [("a", '{"n": 1}'), ("a", '{"n": 2}')])
    engine.put("last", [("k", "1"), ("k", "2"), ("j", "3")])
    first = [r.id for r in engine.collection("log", 0, 1).collect()]
    assert [json.loads(r.payload_json)["n"] for r in engine.collection("log", first[0], 10).collect()] == [2]
    assert engine.collection("log", 0, 0).count() == 0
    assert {r.record_key: r.payload_json for r in engine.state("last").collect()} == {"k": "2", "j": "3"}
    for body in ('{"n": -1}', '{"n": true}', "{}", "nope"):
        with pytest.raises(WriteRejected):
            engine.put("log", [("a", body)])
    with pytest.raises(UnknownCollection):
        engine.put("other", [("a", "1")])
    with pytest.raises(InvalidArgument):
        engine.configure("x", "latest_state", {"$ref": "http://elsewhere"})
    engine.excise_record("last", "k")
    assert {r.record_key for r in engine.state("last").collect()} == {"j"} and engine.mutations(0, 10).count() == 3


def test_search(engine):
    hits = engine.search("alpha").collect()
    assert [h.body for h in hits] == ["alpha beta", "alpha knows gamma"] or {h.body for h in hits} == {"alpha beta", "alpha knows gamma"}
    assert all(h.source_id == "src0" for h in hits) and {h.id[:2] for h in hits} == {"l:", "h:"}
    assert engine.project_vectors() == 3  # the active nodes
    both = engine.search("alpha beta").collect()
    assert both[0].body == "alpha beta" and both[0].vector_rank == 1 and both[0].text_rank is not None
    assert [h.body for h in engine.search("alpha beta", limit=1).collect()] == [both[0].body]
    reranked = engine.search("alpha beta", rerank_depth=5, alpha=1.0, scorer=lambda q, ps: [float("gamma" in p) * 9 for p in ps]).collect()
    assert "gamma" in reranked[0].body
    assert [h.body for h in engine.search_text_only("gamma").collect()] == ["beta gamma"]
    assert engine.search('alpha* AND "NEAR(" :^').count() >= 1  # control syntax is text
    with pytest.raises(InvalidArgument):
        engine.search("x", limit=101)
    with pytest.raises(InvalidArgument):
        engine.search("x", view=ReadView(include_inactive=True))
    with pytest.raises(InvalidFilter):
        engine.search("x", Filter(json=(Json("$.status", "open"),)))
    assert engine.search("gamma", use_graph_arm=True).count() >= 1


def test_projections(engine):
    engine.write([node(10, '{"meta": {"rank": 1}, "status": "open", "priority": 2}', "todo"), node(11, '{"meta": {"rank": "1"}, "status": "shut", "priority": "2"}', "todo"), node(12, "no json", "todo")])
    change = engine.configure_projections([Projection("rank", source=("meta", "rank")), Projection("status", frozenset({"filterable", "searchable"}), full_text=True)])
    assert set(change.built) == {"rank", "status"} and engine.configure_projections(list(change.registry.values())).built == ()
    assert {r.logical_id for r in engine.list("todo", where=Filter(attributes={"rank": 1})).collect()} == {"n10", "n11"}
    assert [r.logical_id for r in engine.list("todo", (Json("$.priority", 2, "gte"),)).collect()] == ["n10"]
    assert [r.logical_id for r in engine.list("todo", (Json("$.status", "shut"),)).collect()] == ["n11"]
    assert engine.list("todo", where=Filter(kind="note")).count() == 0
    assert engine.search_projected_text("open", "status").count() == 1
    assert engine.bm25f_search("todo", {"kind": 3.0}).count() == 3
    with pytest.raises(ProjectionRejected):
        engine.write([node(13, '{"meta": {"rank": [1]}}', "todo")])
    with pytest.raises(ProjectionRejected):
        engine.configure_projections([Projection("rank", source=("other",))])
    assert engine.configure_projections([], drop=("rank",)).dropped == ("rank",)
    with pytest.raises(InvalidFilter):
        Json("$.private", "x")
    with pytest.raises(ProjectionRejected):
        Projection("a'b")


def test_graph_and_diagnostics(engine, tmp_path):
    assert [(r.id, r.hop) for r in engine.neighbors("n0").collect()] == [("n1", 1)]
    assert engine.neighbors("n1").count() == 0  # the other edge has ended
    assert {(r.logical_id, r.origin) for r in engine.search_expand("beta gamma").collect()} >= {("n1", "hit")}
    with pytest.raises(InvalidArgument):
        engine.neighbors("n0", 4)
    assert {r.finding for r in engine.check_integrity().collect()} == {"dangling endpoint"}
    manifest = engine.safe_export(str(tmp_path / "x"))
    assert manifest["nodes"]["rows"] == 4
    from quarry.sources.corpus import verify_export

    assert verify_export(engine.spark, str(tmp_path / "x")) == []
    assert engine.trace("src0").count() == 3 and {r.table_name: r.row_count for r in engine.dump_row_counts().collect()}["edges"] == 2


def test_telemetry(engine, spark, tmp_path):
    from quarry.sources.corpus import EVENT, gold_records

    engine.enable_telemetry(str(tmp_path / "events"))
    engine.search("alpha").collect()
    engine.record_feedback(engine.last_query_id, [1], [2, 1], "user")
    log = spark.read.schema(EVENT).json(str(tmp_path / "events")).withColumn("n", F.monotonically_increasing_id())
    (r,) = gold_records(log, "n").collect()
    assert r.labels == {1: 0, 2: 0} and set(r.candidate_ids) == {1, 5}


def test_extractor(engine, spark):
    stub = "import sys,json\nfor l in sys.stdin:\n d=json.loads(l)['documents'][0]\n print(json.dumps({'source_doc_id':d['source_doc_id'],'entities':[{'name':'Ann','type':'person','aliases':['A']},{'name':'Bo','type':'person'}],'edges':[{'relation':'knows','from_entity':'a','to_entity':'bo','t_valid':'2020-01-02T00:00:00Z','confidence':0.5}]}))"
    docs = spark.createDataFrame([("d1", "x"), ("d2", "y")], "source_doc_id string, body string")
    engine.ingest_with_extractor([sys.executable, "-c", stub], docs)
    engine.ingest_with_extractor([sys.executable, "-c", stub], docs)
    facts = engine.table("edges").filter("body IS NULL AND t_valid = 1577923200").collect()
    assert len(facts) == 2 and sum(f.superseded_at is None for f in facts) == 1
    assert engine.list("person").count() == 2


def test_dense_refusal(engine, spark):
    a = spark.createDataFrame([(1, [1.0] * 32)], "probe int, embedding array<float>")
    b = spark.createDataFrame([(1, [-1.0] + [1.0] * 31)], "probe int, embedding array<float>")
    engine.verify_embedder(a, b)
    assert engine.dense_disabled and engine.search("alpha").count() >= 1
    engine.verify_embedder(a, a)
    assert not engine.dense_disabled


def test_the_filter_comes_before_the_nearest_vectors(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"), now=lambda: 1000, embedder=hashing_embedder(32), dim=32)
    e.write([node(i, f"alpha beta {i}") for i in range(30)] + [node(40, "gamma delta", "email")])
    e.project_vectors()
    (hit,) = e.search("alpha beta", Filter(kind="email")).collect()
    assert hit.logical_id == "n40" and hit.vector_rank == 1 and hit.text_rank is None
    # Vectors of superseded versions neither fill the ten nor come back.
    e.write([node(i, f"alpha beta new {i}") for i in range(30)])
    assert e.project_vectors() == 61
    hits = e.search("alpha beta").collect()
    assert all(h.vector_rank is not None and "new" in h.body for h in hits) and len(hits) == 10
    e.compact()
    assert e.table("vectors").count() == 31 and [h.id for h in e.search("alpha beta").collect()] == [h.id for h in hits]


def test_searches_stem_and_fold(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"), now=lambda: 1000)
    e.write([node(1, "she was running to the café"), node(2, "nothing else here")])
    for query in ("run", "cafe", "Café", "runs", "RUNNING"):
        assert [h.logical_id for h in e.search(query).collect()] == ["n1"]
        assert e.search_text_only(query).count() == 1 and e.bm25f_search(query).count() == 1


def test_explanation(engine):
    engine.project_vectors()
    x = engine.search_explained("alpha beta", use_graph_arm=True, rerank_depth=5, scorer=lambda q, ps: [1.0] * len(ps))
    hits, why = x.hits.collect(), x.per_hit.collect()
    assert [h.write_cursor for h in hits] == [w.id for w in why] and all(w.ce_score is not None and w.blended is not None for w in why)
    assert {w.arm for w in why} <= {"vector", "text", "graph"} and x.trace["missing"] == []
    assert x.trace["query_chars"] == 10 and x.trace["text_hits"] == 3 and x.trace["vector_hits"] == 2 and x.trace["graph_hits"] >= 2 and x.trace["ce_active"]
    assert "beta" not in json.dumps(x.trace)
    engine.write([node(10, '{"rank": 1, "text": "alpha"}', "todo")])
    engine.configure_projections([Projection("rank")])
    t = engine.search_explained("alpha", Filter(attributes={"rank": 1})).trace
    assert t["dropped_edge_hits"] == 1 and t["text_hits"] == 1
    assert engine.search_explained("zzz").trace["missing"] == ["text"]


def test_graph_arm_is_bounded_and_weighed(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"), now=lambda: 1000)
    people = [node(i, f"person number {i}") for i in range(60)]
    links = [{"kind": "knows", "from": f"n{i}", "to": f"n{30 + i}", "source_id": f"edge{i}", "body": "meets often", "confidence": 0.1 if i == 0 else 0.9} for i in range(30)]
    e.write(people, links)
    x = e.search_explained("meets", use_graph_arm=True)
    assert x.trace["graph_hits"] == 20  # both ends of ten facts, not of thirty
    reached = [{h.body: h.score for h in e.search("meets", limit=50, use_graph_arm=True, importance=w).collect()} for w in (False, True)]
    assert all(reached[1][b] <= s + 1e-12 for b, s in reached[0].items())


def test_confidence_weighs_the_graph_arm(spark):
    from quarry.operators import fusion

    arm = spark.createDataFrame([("q", "a", 1, 0.5), ("q", "b", 2, None)], "query_id string, body string, rank int, confidence double")
    plain = {r.body: r.score for r in fusion.fuse({"graph": arm}).collect()}
    weighed = {r.body: r.score for r in fusion.fuse({"graph": arm}, weigh_confidence=True).collect()}
    assert weighed["a"] == pytest.approx(plain["a"] / 2) and weighed["b"] == plain["b"]


def test_graph_hits_name_the_edge_they_came_by(spark):
    from quarry.operators import graph

    nodes = spark.createDataFrame([(i, f"n{i}", "active", None, None, None) for i in range(4)], "write_cursor long, logical_id string, state string, valid_from long, valid_until long, superseded_at long")
    rows = [("n0", "n1", "weak", 0.2), ("n0", "n1", "sure", 0.8), ("n1", "n2", "blank", None), ("n0", "n3", "far", 0.5)]
    edges = spark.createDataFrame([(10 + i, *r, None, None) for i, r in enumerate(rows)], "write_cursor long, from_id string, to_id string, source_id string, confidence double, superseded_at long, t_invalid long")
    got = {r.logical_id: (r.rank, r.confidence, r.via) for r in graph.graph_arm(spark.createDataFrame([("q", "n0")], "query_id string, logical_id string"), nodes, edges, 2, 0).collect()}
    assert got == {"n0": (1, 1.0, None), "n1": (2, 0.8, "sure"), "n3": (3, 0.5, "far"), "n2": (4, 1.0, "blank")}


def test_the_mean_is_pinned_once_and_recomputed_by_hand(spark, tmp_path, monkeypatch):
    from quarry.operators import vector

    monkeypatch.setattr(vector, "PIN_AFTER", 4)
    e = Engine(spark, str(tmp_path / "w"), now=lambda: 1000, embedder=hashing_embedder(16), dim=16)
    e.write([node(i, f"alpha w{i}") for i in range(3)])
    e.project_vectors()
    assert e.meta["mean"] is None
    e.write([node(i, f"alpha w{i}") for i in range(3, 6)])
    e.project_vectors()
    pinned = e.meta["mean"]
    assert pinned is not None
    e.write([node(i, f"beta w{i}") for i in range(6, 9)])
    e.project_vectors()
    assert e.meta["mean"] == pinned
    means = {r.pos: r["mean"] for r in e.recompute_mean().collect()}
    rows = [r.embedding for r in e.table("vectors").collect()]
    assert e.meta["mean"] != pinned and all(abs(means[i] - sum(v[i] for v in rows) / len(rows)) < 1e-6 for i in range(16))
    r = e.table("vectors").first()
    assert all(abs(c - (v - means[i])) < 1e-5 for i, (c, v) in enumerate(zip(r.centred, r.embedding)))
    assert r.bits[0] == sum(1 << i for i, c in enumerate(r.centred) if c > 0)
    assert e.search("beta").first().vector_rank is not None


def test_a_workspace_by_uri_appends_only(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/w", now=lambda: 1000)
    e.write([node(1, "one"), node(2, "two")])
    before = {p: p.stat().st_mtime_ns for p in Path(tmp_path / "w").rglob("*.parquet")}
    e.write([node(1, "uno")], [{"kind": "k", "from": "n1", "to": "n2", "source_id": "s"}])
    assert before == {p: p.stat().st_mtime_ns for p in before}  # nothing was written again
    assert {(r.body, r.superseded_at) for r in e.table("nodes").collect()} == {("one", 3), ("two", None), ("uno", None)}
    e.compact()
    assert not any(p.exists() for p in before)
    assert {(r.body, r.superseded_at) for r in Engine(spark, f"file://{tmp_path}/w").table("nodes").collect()} == {("one", 3), ("two", None), ("uno", None)}
    import inspect

    import quarry.engine as module

    assert "pathlib" not in inspect.getsource(module) and "open(" not in inspect.getsource(module).replace("def open_report", "")


def test_row_kinds_have_their_own_indexes(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"), now=lambda: 1000, embedder=hashing_embedder(16), dim=16)
    e.write([node(i, f"foxtrot golf {i}", row_kind=k) for i, k in enumerate(["leaf"] * 3 + ["coverage"] * 2 + ["graph"])])
    assert e.project_vectors() == 5
    assert [e.rows_of(k).count() for k in ("leaf", "coverage", "graph")] == [3, 2, 1]
    assert e.search_text_only("foxtrot").count() == 6
    with pytest.raises(InvalidArgument):
        e.rows_of("twig")


def test_what_has_no_values_yet_is_deferred():
    from quarry.operators.projections import configure

    first = configure({}, [Projection("importance", frozenset({"rankable"})), Projection("summary", frozenset({"searchable"}), vector=True), Projection("status", frozenset({"filterable", "rankable"}))])
    assert first.built == ("status",) and first.deferred == ("importance", "summary", "status")
    again = configure(first.registry, list(first.registry.values()))
    assert again.built == again.dropped == again.deferred == () and len(again.unchanged) == 3
    assert configure({}, [Projection("summary", frozenset({"searchable"}), vector=True)], embeds=True).deferred == ()
