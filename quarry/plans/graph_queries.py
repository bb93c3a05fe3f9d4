"""Graph queries (G1-G12, J3-J10) over node, hub_node and edge."""

from pyspark.sql import functions as F

from quarry.operators import fusion, graph, lifecycle, textindex
from quarry.operators.views import DEFAULT_VIEW, edge_live
from quarry.plans.frames import ARTICLES, EDGES, LIVE, NODES, NOW, VALID, articles, edges, nodes, searches
from quarry.plans.text_queries import _bm25
from quarry.session import cut, table

#: What every question asks for beside its source type, and the instants of the temporal walk.
PHRASE = "regional harbour sensor report"
INSTANTS = (NOW - 200_000_000, NOW, NOW + 200_000_000)


def _roots(spark, d):
    """The stated roots: every pending or place hub and its like would do; here all nodes of kind project."""
    return nodes(spark, d).filter("kind = 'project'").select(F.col("logical_id").alias("root")).distinct()


def neighbors_depth1(spark, d):
    return graph.neighbours(nodes(spark, d), edges(spark, d), _roots(spark, d), 1, "outgoing", NOW)


def neighbors_depth2(spark, d):
    return graph.neighbours(nodes(spark, d), edges(spark, d), _roots(spark, d), 2, "both", NOW)


def neighbors_depth3(spark, d):
    """Nearest hop of everything within three incoming hops of the topics, at most 50 each."""
    roots = nodes(spark, d).filter("kind = 'topic'").select(F.col("logical_id").alias("root")).distinct()
    return graph.neighbours(nodes(spark, d), edges(spark, d), roots, 3, "incoming", NOW)


def search_expand(spark, d):
    """Names that a search hits, and what they are linked to."""
    n = DEFAULT_VIEW.of(nodes(spark, d), NOW)
    asked = table(spark, d, "hub_node").select(F.col("logical_id").alias("query_id"), F.col("body").alias("text")).distinct()
    hits = textindex.top(textindex.bm25(n, "write_cursor", F.col("body"), asked), 5).join(n.select(F.col("write_cursor").alias("doc"), "logical_id"), "doc")
    return graph.search_expand(hits.select("query_id", "logical_id"), nodes(spark, d), edges(spark, d), 1, NOW)


def dangling_edges(spark, d):
    return lifecycle.dangling_endpoints(edges(spark, d), nodes(spark, d))


def graph_arm_seeds(spark, d):
    e, n = edges(spark, d), nodes(spark, d)
    facts = e.filter(edge_live(NOW) & F.col("body").isNotNull())
    hits = textindex.top(textindex.bm25(facts, "write_cursor", F.col("body"), searches(spark), every=False), 10).withColumnRenamed("doc", "write_cursor")
    none = n.limit(0).select(F.lit("").alias("query_id"), "logical_id")
    return graph.seeds(hits, none, n, e, NOW)


def frontier_stats(spark, d):
    """How many endpoints of live facts are active nodes."""
    e = edges(spark, d).filter(edge_live(NOW))
    ends = e.selectExpr("stack(2, from_id, to_id) AS logical_id").distinct()
    return graph.frontier_stats(ends, ends.join(nodes(spark, d).filter("state = 'active'").select("logical_id").distinct(), "logical_id", "left_semi")).select("considered", "resolved", F.round("rate", 6).alias("rate"))


def neighbors_temporal(spark, d):
    """What the topics lead to at three instants: facts that have ended and nodes not yet valid are passed over."""
    roots, out = nodes(spark, d).filter("kind = 'topic'").select(F.col("logical_id").alias("root")).distinct(), None
    for at in INSTANTS:
        one = graph.neighbours(nodes(spark, d), edges(spark, d), roots, 2, "both", at).withColumn("as_of", F.lit(at).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


def _questions(spark, d):
    """Articles as passages of one question per source type; their entities are the nodes that facts from them name."""
    a = table(spark, d, "article").select("doc_id", F.col("source_type").alias("question")).filter("question IS NOT NULL").distinct()
    e = edges(spark, d).filter("source_id IS NOT NULL").select(F.col("source_id").alias("doc_id"), "from_id", "to_id").join(a, "doc_id")
    mentions = e.selectExpr("question", "doc_id AS passage", "stack(2, from_id, to_id) AS entity").filter("entity IS NOT NULL").distinct()
    relations = e.select("question", F.col("from_id").alias("subject"), F.col("to_id").alias("object")).filter("subject IS NOT NULL AND object IS NOT NULL")
    return a.withColumnRenamed("doc_id", "passage"), mentions, relations


def _by_text(spark, d, passages):
    """The passages of each question by BM25 of its text, which is its source type and a fixed phrase."""
    asked = passages.select("question").distinct().select(F.col("question").alias("query_id"), F.concat_ws(" ", "question", F.lit(PHRASE)).alias("text"))
    scores = textindex.bm25(articles(spark, d), "doc_id", F.col("body"), asked).select(F.col("query_id").alias("question"), F.col("doc").alias("passage"), "score")
    return graph.ranked_passages(passages.join(scores, ["question", "passage"], "left"), "score")


def entity_graph(spark, d):
    _, mentions, relations = _questions(spark, d)
    names, pairs = graph.entity_graph(mentions, relations)
    return names.groupBy("question").agg(F.count(F.lit(1)).alias("entities")).join(pairs.groupBy("question").agg(F.count(F.lit(1)).alias("pairs")), "question")


def seed_weights(spark, d):
    """Entities of the ten best passages of each question by BM25, rare ones heavier."""
    passages, mentions, _ = _questions(spark, d)
    n = passages.groupBy("question").agg(F.count(F.lit(1)).alias("n_passages"))
    return graph.seed_weights(mentions, _by_text(spark, d, passages), n).select("question", "entity", F.round("weight", 9).alias("weight"))


def ppr_fusion(spark, d):
    """Passages by BM25 and by the mass of their entities, fused at 60 (no SQL counterpart: power iteration)."""
    passages, mentions, relations = _questions(spark, d)
    n = passages.groupBy("question").agg(F.count(F.lit(1)).alias("n_passages"))
    names, pairs = graph.entity_graph(mentions, relations)
    text = cut(_by_text(spark, d, passages))
    mass = graph.personalised_pagerank(names, pairs, graph.seed_weights(mentions, text, n))
    scores = graph.passage_scores(mentions, mass).withColumn("score", F.round("score", 9))
    walked = graph.ranked_passages(passages.join(scores, ["question", "passage"], "left"), "score")
    both = text.withColumn("arm", F.lit("text")).unionByName(walked.withColumn("arm", F.lit("graph")))
    fused = fusion.rrf_unweighted(both.select(F.col("question").alias("query_id"), "arm", F.col("passage").alias("id"), "rank"))
    return fused.select(F.col("query_id").alias("question"), F.col("id").alias("passage"), "score")


QUERIES = {f.__name__: f for f in (neighbors_depth1, neighbors_depth2, neighbors_depth3, neighbors_temporal, search_expand, dangling_edges, graph_arm_seeds, frontier_stats, entity_graph, seed_weights, ppr_fusion)}

_ALIVE = f"{NODES}, {EDGES}, alive AS (SELECT DISTINCT logical_id AS id FROM node_rows WHERE {VALID}), live AS (SELECT from_id, to_id FROM edge_rows WHERE {LIVE})"
_OUT = "step AS (SELECT DISTINCT from_id AS a, to_id AS b FROM live WHERE to_id IN (SELECT id FROM alive))"
_IN = "step AS (SELECT DISTINCT to_id AS a, from_id AS b FROM live WHERE from_id IN (SELECT id FROM alive))"
_BOTH = "step AS (SELECT DISTINCT a, b FROM (SELECT from_id AS a, to_id AS b FROM live UNION ALL SELECT to_id, from_id FROM live) WHERE b IN (SELECT id FROM alive))"


def _reach(step, roots, depth):
    return f"""WITH RECURSIVE {_ALIVE}, {step},
walk(root, id, hop) AS (SELECT id, id, 0 FROM alive WHERE id IN ({roots}) UNION SELECT root, b, hop + 1 FROM walk JOIN step ON a = id WHERE hop < {depth}),
near AS (SELECT root, id, min(hop) AS hop FROM walk GROUP BY root, id HAVING min(hop) > 0)"""


_CAPPED = " SELECT root, id, hop FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY hop, id) AS place FROM near) WHERE place <= 50"
_KIND = "SELECT logical_id FROM node_rows WHERE kind = '{}'"
_QUESTIONS = f"""{EDGES}, a AS (SELECT DISTINCT doc_id, source_type AS question FROM article WHERE source_type IS NOT NULL),
qe AS (SELECT question, doc_id, from_id, to_id FROM edge_rows JOIN a ON source_id = doc_id),
m AS (SELECT DISTINCT question, doc_id AS passage, entity FROM (SELECT question, doc_id, from_id AS entity FROM qe UNION ALL SELECT question, doc_id, to_id FROM qe) WHERE entity IS NOT NULL)"""

SQL = {
    "neighbors_depth1": _reach(_OUT, _KIND.format("project"), 1) + _CAPPED,
    "neighbors_depth2": _reach(_BOTH, _KIND.format("project"), 2) + _CAPPED,
    "neighbors_depth3": _reach(_IN, _KIND.format("topic"), 3) + _CAPPED,
    "dangling_edges": f"WITH {NODES}, {EDGES}, e AS (SELECT write_cursor, 'from' AS side, from_id AS id FROM edge_rows UNION ALL SELECT write_cursor, 'to', to_id FROM edge_rows) SELECT write_cursor, side, id FROM e WHERE NOT coalesce(id IN (SELECT logical_id FROM node_rows WHERE state = 'active'), false)",
    "graph_arm_seeds": f"WITH {NODES}, {EDGES}, " + _bm25("edge_rows", "write_cursor", "body", 1.5, 0.75, False, extra=f"WHERE {LIVE} AND body IS NOT NULL") + f""", e AS (SELECT query_id, from_id, to_id FROM ranked JOIN edge_rows ON doc = write_cursor WHERE rank <= 10 AND {LIVE} AND NOT coalesce(temporal_fallback = 1, false))
SELECT DISTINCT query_id, logical_id FROM (SELECT query_id, from_id AS logical_id FROM e UNION ALL SELECT query_id, to_id FROM e) WHERE logical_id IN (SELECT logical_id FROM node_rows WHERE state = 'active')""",
    "frontier_stats": f"WITH {NODES}, {EDGES}, e AS (SELECT DISTINCT id FROM (SELECT from_id AS id FROM edge_rows WHERE {LIVE} UNION ALL SELECT to_id FROM edge_rows WHERE {LIVE})) SELECT count(*) AS considered, count(*) FILTER (id IN (SELECT logical_id FROM node_rows WHERE state = 'active')) AS resolved, round(count(*) FILTER (id IN (SELECT logical_id FROM node_rows WHERE state = 'active')) / count(*), 6) AS rate FROM e",
    "entity_graph": f"""WITH {_QUESTIONS}, n AS (SELECT question, count(*) AS entities FROM (SELECT question, entity FROM m UNION SELECT question, from_id FROM qe WHERE to_id IS NOT NULL AND from_id IS NOT NULL UNION SELECT question, to_id FROM qe WHERE to_id IS NOT NULL AND from_id IS NOT NULL) GROUP BY question),
p AS (SELECT question, count(*) AS pairs FROM (SELECT DISTINCT question, least(from_id, to_id) AS x, greatest(from_id, to_id) AS y FROM qe WHERE from_id <> to_id) GROUP BY question) SELECT question, entities, pairs FROM n JOIN p USING (question)""",
    "seed_weights": f"WITH {_QUESTIONS}, {ARTICLES}, " + _bm25("article_rows", "doc_id", "body", 1.5, 0.75, True, queries=f"searched AS (SELECT DISTINCT question AS query_id, question || ' {PHRASE}' AS text FROM a)") + """, r AS (SELECT question, a.doc_id AS passage, row_number() OVER (PARTITION BY question ORDER BY coalesce(score, 0) DESC, a.doc_id) AS rank FROM a LEFT JOIN scored ON query_id = question AND doc = a.doc_id),
n AS (SELECT question, count(*) AS n FROM a GROUP BY question), f AS (SELECT question, entity, count(*) AS df FROM m GROUP BY question, entity),
s AS (SELECT DISTINCT question, entity FROM m JOIN r USING (question, passage) WHERE r.rank <= 10)
SELECT question, entity, round(CASE WHEN ln((n.n + 1) / (f.df + 0.5)) > 0 THEN ln((n.n + 1) / (f.df + 0.5)) ELSE 1e-6 END, 9) AS weight FROM s JOIN f USING (question, entity) JOIN n USING (question)""",
    "neighbors_temporal": " UNION ALL ".join(f"SELECT * FROM ({_reach(_BOTH, _KIND.format('topic'), 2)}{_CAPPED.replace('SELECT root, id, hop', f'SELECT root, id, hop, {t}::BIGINT AS as_of')})".replace(str(NOW), str(t)) for t in INSTANTS),
    "search_expand": f"WITH {_ALIVE}, {_BOTH}, names AS (SELECT * FROM node_rows WHERE {VALID}), " + _bm25("names", "write_cursor", "body", 1.5, 0.75, True, queries="searched AS (SELECT DISTINCT logical_id AS query_id, body AS text FROM hub_node)") + """,
h AS (SELECT query_id, logical_id FROM ranked JOIN names ON doc = write_cursor WHERE rank <= 5), near AS (SELECT DISTINCT a AS root, b AS id FROM step WHERE a IN (SELECT logical_id FROM h) AND a IN (SELECT id FROM alive) AND a <> b),
capped AS (SELECT root, id FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY id) AS place FROM near) WHERE place <= 50)
SELECT query_id, logical_id, 'hit' AS origin, 0 AS hop FROM h UNION ALL SELECT DISTINCT query_id, id, 'expanded', 1 FROM h JOIN capped ON root = logical_id WHERE (query_id, id) NOT IN (SELECT (query_id, logical_id) FROM h)""",
}
