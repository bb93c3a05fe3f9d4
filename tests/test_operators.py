import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.errors import InvalidArgument
from quarry.functions import epochs, jsons
from quarry.functions.text import canonical, canonical_relation, content_terms, match_expression, porter
from quarry.operators import evalkit, fusion, graph, lifecycle, metrics, textindex
from quarry.sources.corpus import gold_records


def test_query_terms():
    assert match_expression("status of the alpha alpha") == '"status" OR "alpha"'
    assert match_expression('alpha* AND "beta" NEAR(gamma)') == '"alpha" OR "beta" OR "near" OR "gamma"'
    assert match_expression("who are we") == '"who" OR "are" OR "we"'
    assert content_terms("Ünï") == ["ünï"]


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("digitizer", "digit"), ("triplicate", "triplic"), ("revival", "reviv"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control"), ("running", "run"), ("connected", "connect")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_canonical():
    assert canonical("  Café  Naïve ") == "cafe naive" and canonical_relation("Works - for") == "works_for" and canonical(None) == ""


def test_instants(spark):
    texts = ["2020-01-02", "2020-01-02T03:04:05Z", "2020-01-02T03:04+01:00", "2022", "2020-13-01", "now", None, "2020-01-02 03:04"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(epochs.epoch(F.col("t")), epochs.malformed(F.col("t"))).collect()]
    assert [g[0] for g in got] == [1577923200, 1577934245, 1577930640, None, None, None, None, None]
    assert [g[1] for g in got] == [False, False, False, True, True, True, False, True]


def test_typed_json(spark):
    bodies = ['{"a": 1}', '{"a": "1"}', '{"a": true}', '{"a": null}', '{"a": 1.5}', '{"a": {"b": 2}}', "{}", "no", None]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    ints = [r[0] for r in df.select(jsons.typed(F.col("b"), "$.a", "bigint")).collect()]
    assert ints == [1] + [None] * 8
    texts = [r[0] for r in df.select(jsons.scalar_text(F.col("b"), "$['a']")).collect()]
    assert texts == ["1", "1", "true", None, "1.5", None, None, None, None]


def arm(spark, rows):
    return spark.createDataFrame([("q", b, i) for i, b in enumerate(rows, 1)], "query_id string, body string, rank int")


def test_fusion_weights_and_ties(spark):
    fused = {r.body: r for r in fusion.fuse({"vector": arm(spark, ["a", "b", "c"]), "text": arm(spark, ["b", "d"])}).collect()}
    assert fused["b"].score == pytest.approx(1 / 32 + 3 / 31) and fused["b"].branch == "vector"
    assert fused["d"].score > fused["c"].score  # text weighs more
    even = fusion.fuse({"vector": arm(spark, ["x"]), "text": arm(spark, ["y"])}, weights={"vector": 1.0, "text": 1.0})
    assert [r.body for r in even.orderBy(*fusion.fused_order(["vector", "text"])).collect()] == ["x", "y"]


def test_blend(spark):
    rows = spark.createDataFrame([("q", "a", 1, 3.0, -4.0), ("q", "b", 2, 2.0, 4.0), ("q", "c", 3, 1.0, float("nan")), ("q", "d", 4, 0.5, 9.0)], "query_id string, body string, rank int, score double, logit double")
    assert [r.body for r in fusion.blend(rows, "logit", 1.0, 3).orderBy("rank").collect()] == ["b", "a", "c", "d"]
    assert [r.body for r in fusion.blend(rows, "logit", 0.0, 3).orderBy("rank").collect()] == ["a", "b", "c", "d"]
    flat = fusion.blend(rows.withColumn("score", F.lit(1.0)), "logit", 0.0, 3).filter("rank <= 3").collect()
    assert all(r.blended == 1.0 for r in flat)
    with pytest.raises(InvalidArgument):
        fusion.blend(rows, "logit", 1.5)


def test_reweighting(spark):
    rows = spark.createDataFrame([("q", 1, 0.5, None, None), ("q", 9, 0.5, 0.5, 0.5)], "query_id string, write_cursor long, score double, importance double, confidence double")
    assert [r.score for r in fusion.with_recency(rows).orderBy("write_cursor").collect()] == [0.5, 0.502]
    assert [r.score for r in fusion.with_importance(rows).orderBy("write_cursor").collect()] == [0.5, 0.125]


def chain(spark):
    nodes = spark.createDataFrame([(i, f"n{i}", "active", None, None) for i in range(6)] + [(9, "gone", "deleted", None, None)], "write_cursor long, logical_id string, state string, valid_from long, valid_until long")
    links = [("n0", "n1", None), ("n1", "n2", None), ("n2", "n0", None), ("n2", "n3", None), ("n0", "n4", 5), ("n1", "gone", None), ("gone", "n5", None)]
    edges = spark.createDataFrame([(i, a, b, "s", t, None) for i, (a, b, t) in enumerate(links)], "write_cursor long, from_id string, to_id string, source_id string, t_invalid long, superseded_at long")
    return nodes, edges


def test_traversal(spark):
    nodes, edges = chain(spark)
    root = spark.createDataFrame([("n0",)], "root string")
    hops = lambda d, way="outgoing": {(r.id, r.hop) for r in graph.neighbours(nodes, edges, root, d, way, 100).collect()}
    assert hops(1) == {("n1", 1)}  # the edge to n4 has ended
    assert hops(3) == {("n1", 1), ("n2", 2), ("n3", 3)}  # nothing through the deleted node, the cycle ends
    assert hops(1, "incoming") == {("n2", 1)} and hops(1, "both") == {("n1", 1), ("n2", 1)}
    assert graph.neighbours(nodes, edges, root, 3, most=2).count() == 2
    assert lifecycle.dangling_endpoints(edges, nodes).count() == 2


def test_pagerank_mass(spark):
    names = spark.createDataFrame([("q", n) for n in "abcd"], "question string, entity string")
    pairs = spark.createDataFrame([("q", "a", "b"), ("q", "b", "c")], "question string, a string, b string")
    seeds = spark.createDataFrame([("q", "a", 2.0)], "question string, entity string, weight double")
    mass = {r.entity: r.mass for r in graph.personalised_pagerank(names, pairs, seeds).collect()}
    assert math.isclose(sum(mass.values()), 1, abs_tol=1e-5) and mass["a"] > mass["c"] > mass["d"] and mass["b"] > mass["c"]
    alone = {r.entity: r.mass for r in graph.personalised_pagerank(names, pairs, seeds, alpha=0.0).collect()}
    assert alone == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0}


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", d, i) for i, d in enumerate("abcdef", 1)], "query_id string, doc_id string, rank int")
    gold = spark.createDataFrame([("q", "b", "required"), ("q", "f", "required"), ("q", "a", "supporting")], "query_id string, doc_id string, necessity string")
    ladder = {r.k: r for r in metrics.evidence_recall(ranked, gold).collect()}
    assert (ladder[5].strict, ladder[5].graded, ladder[5].supporting, ladder[10].strict) == (0.0, 0.5, 1.0, 1.0)
    classes = spark.createDataFrame([("q", "multi_session")], "query_id string, query_class string")
    r = metrics.hit_mrr_ndcg(ranked, gold.filter("necessity = 'required'"), classes, 5).first()
    assert (r.hit, r.mrr) == (0.0, 0.5) and r.ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs=1e-4)
    answers = spark.createDataFrame([("the Cat sat", "a cat sat sat"), (None, "x"), ("the", "an"), ("a", "b")], "prediction string, gold string")
    assert [round(x.f1, 3) for x in metrics.answer_scores(answers).collect()] == [0.8, 0.0, 1.0, 0.0]
    rows = [("g", random.Random(i).randrange(5) * 1.0, i % 2) for i in range(50)]
    auc = metrics.rank_auc(spark.createDataFrame(rows, "g string, s double, y int"), "g", "s", "y").first().auc
    pairs = [(a, b) for _, a, y in rows if y for _, b, z in rows if not z]
    assert auc == pytest.approx(sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs))
    with pytest.raises(InvalidArgument):
        metrics.check_depth(20, 10)


def test_seeded_statistics(spark):
    stream = evalkit.split_mix(0)
    assert [next(stream) for _ in range(2)] == [16294208416658607535, 7960286522194355700]  # published values
    assert evalkit.seeded_interval([], 1, 10) == (0.0, 0.0)
    low, high = evalkit.seeded_interval([0.0, 1.0] * 20, 3, 200)
    assert low < 0.5 < high and evalkit.seeded_interval([0.0, 1.0] * 20, 3, 200) == (low, high)
    assert evalkit.required_pairs(0.1, 0.5) == 197 and evalkit.simulated_power(0.5, 0.5, 50) > 0.99


def test_mmr_prefers_the_new(spark):
    rows = [("q", "a", 1.0, [1.0, 0.0]), ("q", "b", 0.99, [1.0, 0.01]), ("q", "c", 0.5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "query_id string, doc string, rel double, vector array<double>")
    assert [r.doc for r in evalkit.mmr(df, 2).orderBy("place").collect()] == ["a", "c"]
    assert [r.doc for r in evalkit.mmr(df, 3, 1.0).orderBy("place").collect()] == ["a", "b", "c"]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "p1\n\np2\n\n" + "x" * 25), (2, "short"), (3, None), (4, "")], "d int, t string")
    got = {}
    for r in evalkit.paragraph_chunks(df, "d", "t", 10).orderBy("doc", "chunk").collect():
        got.setdefault(r.doc, []).append(r.chunk_text)
    assert got == {1: ["p1\n\np2", "x" * 10, "x" * 10, "x" * 5], 2: ["short"], 4: [""]}
    words = spark.createDataFrame([(1, " ".join(map(str, range(25))))], "d int, t string")
    assert [(r.chunk, r.n_words) for r in evalkit.word_windows(words, "d", F.col("t"), 10, 8).collect()] == [(0, 10), (1, 10), (2, 9)]


def test_feedback_pairs_like_brackets(spark):
    log = [(1, "event", "q", [1]), (2, "event", "q", [2]), (3, "feedback", "q", None), (4, "feedback", "q", None), (5, "feedback", "q", None), (6, "event", "q", [6]), (7, "feedback", "q", None), (8, "event", "q", [8]), (9, "event", None, [9]), (10, "odd", "q", [3])]
    df = spark.createDataFrame([(n, t, q, ids, 3, [n], []) for n, t, q, ids in log], "n int, type string, query_id string, result_ids array<long>, query_chars int, relevant_ids array<long>, irrelevant_ids array<long>")
    got = {next(iter(r.labels)): r.candidate_ids[0] for r in gold_records(df, "n").collect()}
    assert got == {3: 2, 4: 1, 7: 6}


def test_retention_and_versions(spark):
    log = spark.createDataFrame([(i, "audit" if i % 10 == 0 else "x") for i in range(1, 101)], "id int, k string")
    kept = {r.id for r in lifecycle.retained(log, 20, "id", F.col("k") == "audit").collect()}
    assert len([i for i in kept if i % 10]) == 20 and {10, 20, 100} <= kept
    assert lifecycle.retained(log, 99, "id").count() == 100  # within the slack


def test_prefix_stability(spark):
    docs = spark.createDataFrame([(i, "alpha " * (i % 4 + 1) + "beta") for i in range(40)], "d int, t string")
    q = spark.createDataFrame([("q", "alpha beta")], "query_id string, text string")
    scored = textindex.bm25(docs, "d", F.col("t"), q)
    full = [r.doc for r in textindex.top(scored, 40).orderBy("rank").collect()]
    for n in (1, 7, 23):
        assert [r.doc for r in textindex.top(scored, n).orderBy("rank").collect()] == full[:n]
    for bad in (0, 101, True, 2.0):
        with pytest.raises(InvalidArgument):
            textindex.top(scored, bad)


def test_every_document_is_predicted_by_the_other_folds(spark):
    from quarry.functions.text import terms

    rows = [(i, "xy"[i % 2], i % 3, f"{'red' if i % 2 else 'blue'} word own{i}") for i in range(12)] + [(12, "y", 0, ""), (13, "x", 1, "red red")]
    got = evalkit.held_out(spark.createDataFrame(rows, "doc int, label string, fold int, text string"), terms(F.col("text")), 3).collect()
    assert sorted(r.doc for r in got) == list(range(14))
    assert all(r.predicted == r.label for r in got if r.doc < 12)
    assert {r.doc: r.predicted for r in got if r.doc >= 12} == {12: "x", 13: "y"}


def test_intent_classifier_covers_the_table(spark):
    from quarry.plans.text_queries import intent_classifier
    from quarry.session import table

    sf = "/root/testdata/sf0.001"
    want = table(spark, sf, "documents").filter("text IS NOT NULL AND source_type IS NOT NULL").count()
    assert intent_classifier(spark, sf).agg(F.sum("documents")).first()[0] == want


def test_folded_terms(spark):
    from quarry.functions.text import fold_text, folded_terms

    texts = ["Café naïve Straße", "ÅNGSTRÖM étude", "plain 42", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(folded_terms(F.col("t"))).collect()]
    assert got == [["cafe", "naive", "stra", "e"], ["angstrom", "etude"], ["plain", "42"], [], None]
    assert fold_text("Café") == "cafe"


def test_stemmed_ranking_has_idf_length_and_saturation(spark):
    docs = [("a", "running runs run"), ("b", "the runner was running far away from all of the other people there"), ("c", "nothing"), ("d", "a run")]
    df = spark.createDataFrame(docs, "id string, t string")
    asked = spark.createDataFrame([("q", "runs")], "query_id string, text string")
    got = {r.doc: r.score for r in textindex.bm25(df, "id", F.col("t"), asked, textindex.Okapi(1.2, 0.75), stems=True).collect()}
    counts, lengths = {"a": 3, "b": 1, "d": 1}, {"a": 3, "b": 13, "c": 1, "d": 2}
    mean, idf = sum(lengths.values()) / 4, math.log(1 + (4 - 3 + 0.5) / (3 + 0.5))
    assert got == {k: pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[k] / mean)), abs=1e-8) for k, tf in counts.items()}
    many = spark.createDataFrame([(f"q{i}", "runs walks") for i in range(700)], "query_id string, text string")
    assert textindex.query_terms(many, stems=True).count() == 1400  # stemmed on the executors beyond the driver's bound
    fielded = textindex.bm25_fielded(df, "id", {"t": F.col("t")}, asked, stems=True)
    assert {r.doc for r in fielded.collect()} == set(counts)


def test_tfidf_cosine(spark):
    docs = {"a": "x y y", "b": "y z", "c": "w"}
    df = spark.createDataFrame(list(docs.items()), "id string, t string")
    asked = spark.createDataFrame([("q", "Y y unknown z")], "query_id string, text string")
    from quarry.functions.text import terms

    got = {r.doc: r.score for r in evalkit.tfidf_cosine(df, "id", terms(F.col("t")), asked).collect()}
    idf = {"x": math.log(3) + 1, "y": math.log(3 / 2) + 1, "z": math.log(3) + 1}
    vec = lambda words: {w: words.count(w) * idf[w] for w in words if w in idf}
    dot = lambda u, v: sum(u[k] * v.get(k, 0) for k in u)
    q = vec(["y", "y", "z"])
    assert got == {k: pytest.approx(dot(q, vec(docs[k].split())) / math.sqrt(dot(q, q) * dot(vec(docs[k].split()), vec(docs[k].split()))), abs=1e-8) for k in ("a", "b")}


def test_pagerank_small_and_large_agree(spark):
    rnd = random.Random(3)
    nodes = spark.createDataFrame([(q, f"e{i}") for q in ("one", "two", "none") for i in range(30)], "question string, entity string")
    pairs = {(q, *sorted(rnd.sample(range(25), 2))) for q in ("one", "two") for _ in range(60)}
    edges = spark.createDataFrame([(q, f"e{a}", f"e{b}") for q, a, b in pairs], "question string, a string, b string")
    weights = spark.createDataFrame([("one", "e1", 2.0), ("one", "e29", 1.0), ("two", "e3", 1.0), ("two", "elsewhere", 9.0)], "question string, entity string, weight double")
    one = {(r.question, r.entity): r.mass for r in graph.personalised_pagerank(nodes, edges, weights, tolerance=1e-4).collect()}
    two = {(r.question, r.entity): r.mass for r in graph.personalised_pagerank(nodes, edges, weights, tolerance=1e-4, most_rows=0).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)
    assert sum(m for (q, _), m in one.items() if q == "one") == pytest.approx(1) and all(m == 0 for (q, _), m in one.items() if q == "none")


def test_win_rate_intervals(spark):
    rows = [("a", f"q{i}", o) for i in range(40) for o in (["win", "win"] if i < 30 else ["loss", "tie"])] + [("b", "q", "win")]
    got = {r.arm: r for r in evalkit.win_rate_intervals(spark.createDataFrame(rows, "arm string, q string, o string"), "arm", "q", "o").collect()}
    assert got["a"].n == 80 and got["a"].win_rate == pytest.approx((60 + 5) / 80, abs=1e-4)
    assert got["a"].low < got["a"].win_rate < got["a"].high and got["a"].effect == pytest.approx((got["a"].high - got["a"].low) / 2)
    assert (got["b"].low, got["b"].high) == (1.0, 1.0)


def test_purging_many(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "write_cursor long, logical_id string")
    edges = spark.createDataFrame([(10, "a", "b"), (11, "b", "c"), (12, None, "b"), (13, "c", "a")], "write_cursor long, from_id string, to_id string")
    shadow = spark.createDataFrame([(i,) for i in (1, 3, 10, 11, 13)], "write_cursor long")
    n, e, s = lifecycle.purge_all(nodes, edges, spark.createDataFrame([("a",), (None,)], "logical_id string"), {"s": shadow})
    assert [sorted(r.write_cursor for r in t.collect()) for t in (n, e, s["s"])] == [[3, 4], [11, 12], [3, 11]]
