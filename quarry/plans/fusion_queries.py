"""Fusion, reweighting and reranking queries (H1-H15) over search arms and rerank_pool."""

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.vectors import cosine
from quarry.operators import fusion, graph, metrics, textindex, vector
from quarry.operators.textindex import Okapi
from quarry.operators.views import DEFAULT_VIEW, edge_live
from quarry.plans.frames import EDGES, LIVE, NODES, NOW, SEARCHES, VALID, as_integers, edges, nodes, searches
from quarry.plans.text_queries import _bm25
from quarry.plans.vector_queries import _E, _phases
from quarry.session import cut, table


def _pool(spark, d):
    """rerank_pool with one row per (qid, doc_id)."""
    rows = table(spark, d, "rerank_pool").filter("qid IS NOT NULL AND doc_id IS NOT NULL")
    return rows.groupBy(F.col("qid").alias("query_id"), "doc_id").agg(F.max(F.when(~F.isnan("base_score"), F.col("base_score"))).alias("base"), F.max(F.when(~F.isnan("ce_norm"), F.col("ce_norm"))).alias("ce"), F.max("reporting_class").alias("query_class"))


def _ranked_pool(spark, d):
    return fusion.rank_arm(_pool(spark, d), [F.col("base").desc_nulls_last(), F.col("doc_id")])


def _arms(spark, d):
    """Two orders of each pool as the vector and text arms, over the pool's upper halves."""
    pool = _pool(spark, d).withColumn("body", F.col("doc_id"))
    one = fusion.rank_arm(pool, [F.col("base").desc_nulls_last(), F.col("doc_id")]).filter("rank <= 20")
    two = fusion.rank_arm(pool, [F.col("ce").desc_nulls_last(), F.col("doc_id")]).filter("rank <= 20")
    keep = ["query_id", "body", "doc_id", "rank"]
    return {"vector": one.select(*keep), "text": two.select(*keep)}


def _graph_arm(spark, d):
    pool = _pool(spark, d).withColumn("body", F.col("doc_id"))
    return fusion.rank_arm(pool, [F.md5("doc_id"), F.col("doc_id")]).filter("rank <= 10").select("query_id", "body", "doc_id", "rank")


def _numbered(fused, arms):
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*fusion.fused_order(arms)))
    return fused.withColumn("place", place).select("query_id", "doc_id", "score", "branch", "place")


def rrf_two_arm_weighted(spark, d):
    arms = _arms(spark, d)
    return _numbered(fusion.fuse(arms), list(arms))


def rrf_three_arm(spark, d):
    arms = _arms(spark, d) | {"graph": _graph_arm(spark, d)}
    return _numbered(fusion.fuse(arms), list(arms))


def rrf_eval_k60(spark, d):
    rows = None
    for name, arm in _arms(spark, d).items():
        one = arm.select("query_id", F.lit(name).alias("arm"), F.col("doc_id").alias("id"), "rank")
        rows = one if rows is None else rows.unionByName(one)
    return fusion.rrf_unweighted(rows)


def explain_ranks(spark, d):
    """The ranks that each hit had in each arm."""
    return fusion.fuse(_arms(spark, d)).select("query_id", "doc_id", "vector_rank", "text_rank", "branch")


def recency_reweight(spark, d):
    hits = _ranked_pool(spark, d).withColumns({"score": 1.0 / (30 + F.col("rank")), "write_cursor": F.col("rank") * 7 % 41})
    return fusion.with_recency(hits).select("query_id", "doc_id", F.round("score", 9).alias("score"))


def importance_reweight(spark, d):
    """Pool scores weighed by the mean confidence of the edges that come from the document."""
    weight = edges(spark, d).filter(edge_live(NOW)).groupBy(F.col("source_id").alias("doc_id")).agg(F.avg("confidence").alias("confidence"))
    hits = _ranked_pool(spark, d).withColumns({"score": 1.0 / (30 + F.col("rank")), "importance": F.lit(None).cast("double")}).join(weight, "doc_id", "left")
    return fusion.with_importance(hits).select("query_id", "doc_id", F.round("score", 9).alias("score"))


def score_blend(spark, d):
    """The cross-encoder's normalised score (as a logit) blended with the pool's own order."""
    p = F.least(F.greatest(F.coalesce("ce", F.lit(0.0)), F.lit(1e-9)), F.lit(1 - 1e-9))
    hits = _ranked_pool(spark, d).withColumn("score", 1.0 / (30 + F.col("rank"))).withColumn("logit", F.log(p / (1 - p)))
    return fusion.blend(hits, "logit", 0.3, 30).select("query_id", "doc_id", "rank")


def joint_tuning(spark, d):
    """Recall at 5 over a grid of pool sizes and weights; gold is what either score puts first."""
    ranked = _ranked_pool(spark, d)
    best = ranked.groupBy("query_id").agg(F.max_by("doc_id", F.struct(F.coalesce("ce", F.lit(-1.0)), "doc_id")).alias("doc_id"))
    return metrics.tuning_sweep(ranked, best, [10, 20, 40], [0.0, 0.3, 0.7, 1.0], 5)


def hit_identity(spark, d):
    rows = edges(spark, d).filter(edge_live(NOW)).withColumn("logical_id", F.when(F.col("write_cursor") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("logical_id")))
    return rows.filter("body IS NOT NULL").select("write_cursor", fusion.identity().alias("id"))


def soft_fallback(spark, d):
    """Which search arms had nothing: entity names and edge facts, per search."""
    asked = searches(spark)
    arms = {"text": textindex.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), asked, every=False), "graph": textindex.bm25(nodes(spark, d), "write_cursor", F.col("body"), asked, every=False)}
    return fusion.soft_fallback(arms, asked).select("query_id", F.concat_ws(",", "missing").alias("missing"))


def hybrid_search(spark, d):
    """Facts and what they lead to: edge facts by text, and the graph walked from the best facts and entity names, fused by body."""
    asked, n, e = searches(spark), nodes(spark, d), edges(spark, d)
    facts = e.filter(edge_live(NOW) & F.col("body").isNotNull())
    fact_hits = cut(textindex.top(textindex.bm25(facts, "write_cursor", F.col("body"), asked, every=False), 100))
    names = textindex.top(textindex.bm25(DEFAULT_VIEW.of(n, NOW), "write_cursor", F.col("body"), asked, every=False), graph.SEEDS)
    text = fact_hits.join(facts.select(F.col("write_cursor").alias("doc"), "body"), "doc").select("query_id", "body", "rank")
    started = graph.seeds(textindex.top(fact_hits.drop("rank"), graph.SEEDS).withColumnRenamed("doc", "write_cursor"), names.join(n.select(F.col("write_cursor").alias("doc"), "logical_id"), "doc"), n, e, NOW)
    arm = graph.graph_arm(started, n, e, 2, NOW).join(n.filter("body IS NOT NULL").select("logical_id", "body"), "logical_id")
    return _placed({"text": text, "graph": arm.select("query_id", "body", "rank")})


def _placed(arms):
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*fusion.fused_order(list(arms))))
    return fusion.fuse(arms).withColumn("place", place).filter("place <= 10").select("query_id", "body", F.round("score", 9).alias("score"), "branch", "place")


def hybrid_search_vector(spark, d):
    """Documents by text and by vector under one filter, which comes before both arms; the document's vector is the one of its id."""
    asked, vectors = searches(spark), table(spark, d, "embeddings")
    ids = F.concat(F.lit("q"), (F.col("vec_id") / 100 + 1).cast("int"))
    probes = vectors.filter(F.col("vec_id").isin(*[100 * i for i in range(len(SEARCHES))])).select(ids.alias("query_id"), F.col("embedding").alias("q"))
    near = vector.knn_two_phase(vectors, probes, 64, 10, F.col("label") == 3).select("query_id", F.col("vec_id").cast("string").alias("body"), "rank")
    docs = table(spark, d, "documents").select("doc_id", "text").join(vectors.filter("label = 3").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    hits = textindex.top(textindex.bm25(docs, "doc_id", F.col("text"), asked, Okapi(1.2, 0.75), every=False), 100)
    return _placed({"vector": near, "text": hits.select("query_id", F.col("doc").cast("string").alias("body"), "rank")}).withColumnRenamed("body", "doc_id")


def cosine_rerank(spark, d):
    """Pairs of vectors of one document, most similar first (late: only ids travel until ranked)."""
    v = table(spark, d, "embshim_vector").filter("size(embedding) = 384 AND doc_id IS NOT NULL").groupBy("doc_id", "unit_index").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    first = v.filter("unit_index = 0").select("doc_id", F.col("embedding").alias("q"))
    return v.filter("unit_index > 0").join(first, "doc_id").select("doc_id", "unit_index", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity")).filter("similarity IS NOT NULL AND NOT isnan(similarity)")


QUERIES = {f.__name__: f for f in (rrf_two_arm_weighted, rrf_three_arm, rrf_eval_k60, explain_ranks, recency_reweight, importance_reweight, score_blend, joint_tuning, hit_identity, soft_fallback, hybrid_search, hybrid_search_vector, cosine_rerank)}

_POOL = """pool AS (
  SELECT qid AS query_id, doc_id, max(CASE WHEN NOT isnan(base_score) THEN base_score END) AS base, max(CASE WHEN NOT isnan(ce_norm) THEN ce_norm END) AS ce, max(reporting_class) AS query_class
  FROM rerank_pool WHERE qid IS NOT NULL AND doc_id IS NOT NULL GROUP BY qid, doc_id
), ranked_pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base DESC NULLS LAST, doc_id) AS rank FROM pool)"""
_ARMS = _POOL + """, v AS (SELECT query_id, doc_id, rank FROM ranked_pool WHERE rank <= 20),
t AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY ce DESC NULLS LAST, doc_id) AS rank FROM pool) WHERE rank <= 20),
g AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY md5(doc_id), doc_id) AS rank FROM pool) WHERE rank <= 10)"""


def _fused(graph):
    third = " FULL JOIN g USING (query_id, doc_id)" if graph else ""
    gr, gs = ("g.rank", " + coalesce(1.0 / (30 + g.rank), 0)") if graph else ("NULL", "")
    return f"""WITH {_ARMS}, f AS (
  SELECT query_id, doc_id, round(coalesce(1.0 / (30 + v.rank), 0) + coalesce(3.0 / (30 + t.rank), 0){gs}, 12) AS score,
    CASE WHEN v.rank IS NOT NULL THEN 'vector' WHEN t.rank IS NOT NULL THEN 'text' ELSE 'graph' END AS branch,
    CASE WHEN v.rank IS NOT NULL THEN 0 WHEN t.rank IS NOT NULL THEN 1 ELSE 2 END AS arm, v.rank AS vr, t.rank AS tr, {gr} AS gr
  FROM v FULL JOIN t USING (query_id, doc_id){third}
)"""


_PLACED = " SELECT query_id, doc_id, score, branch, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, arm, vr NULLS LAST, tr NULLS LAST, gr NULLS LAST, doc_id) AS place FROM f"

SQL = {
    "rrf_two_arm_weighted": _fused(False) + _PLACED,
    "rrf_three_arm": _fused(True) + _PLACED,
    "rrf_eval_k60": f"WITH {_ARMS} SELECT query_id, doc_id AS id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM t) GROUP BY query_id, doc_id",
    "explain_ranks": _fused(False) + " SELECT query_id, doc_id, vr AS vector_rank, tr AS text_rank, branch FROM f",
    "recency_reweight": f"""WITH {_POOL}, h AS (SELECT query_id, doc_id, 1.0 / (30 + rank) AS s, rank * 7 % 41 AS c FROM ranked_pool), w AS (SELECT *, min(c) OVER (PARTITION BY query_id) AS lo, max(c) OVER (PARTITION BY query_id) AS hi FROM h)
SELECT query_id, doc_id, round(s + 0.002 * CASE WHEN hi > lo THEN (c - lo) / (hi - lo) ELSE 0 END, 9) AS score FROM w""",
    "importance_reweight": f"""WITH {EDGES}, {_POOL}, w AS (SELECT source_id AS doc_id, avg(confidence) AS c FROM edge_rows WHERE {LIVE} GROUP BY source_id)
SELECT query_id, doc_id, round(1.0 / (30 + rank) * coalesce(c, 1), 9) AS score FROM ranked_pool LEFT JOIN w USING (doc_id)""",
    "score_blend": f"""WITH {_POOL}, h AS (SELECT *, 1.0 / (30 + rank) AS s, rank <= 30 AS near FROM ranked_pool), w AS (SELECT *, min(s) OVER (PARTITION BY query_id, near) AS lo, max(s) OVER (PARTITION BY query_id, near) AS hi FROM h),
b AS (SELECT *, CASE WHEN near THEN round(0.3 * least(greatest(coalesce(ce, 0), 1e-9), 1 - 1e-9) + 0.7 * CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 1 END, 12) END AS x FROM w)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY x DESC NULLS LAST, rank) AS rank FROM b""",
    "joint_tuning": f"""WITH {_POOL}, gold AS (SELECT query_id, arg_max(doc_id, (coalesce(ce, -1), doc_id)) AS doc_id FROM ranked_pool GROUP BY query_id),
grid AS (SELECT p AS pool_n, a AS alpha FROM (VALUES (10), (20), (40)) AS x(p), (VALUES (0.0::DOUBLE), (0.3), (0.7), (1.0)) AS y(a)),
h AS (SELECT query_id, doc_id, rank, base, coalesce(ce, 0) AS ce, pool_n, alpha FROM ranked_pool, grid WHERE rank <= pool_n),
w AS (SELECT *, min(base) OVER (PARTITION BY query_id, pool_n, alpha) AS lo, max(base) OVER (PARTITION BY query_id, pool_n, alpha) AS hi FROM h),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id, pool_n, alpha ORDER BY round(alpha * ce + (1 - alpha) * CASE WHEN hi > lo THEN (base - lo) / (hi - lo) ELSE 1 END, 12) DESC, rank, doc_id) AS new_rank FROM w)
SELECT pool_n, alpha, round(avg(CASE WHEN coalesce(new_rank, 99) <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall FROM (gold CROSS JOIN grid) LEFT JOIN s USING (query_id, doc_id, pool_n, alpha) GROUP BY pool_n, alpha""",
    "hit_identity": f"WITH {EDGES} SELECT write_cursor, CASE WHEN write_cursor % 3 <> 0 AND logical_id IS NOT NULL THEN 'l:' || logical_id ELSE 'h:' || sha256(body) END AS id FROM edge_rows WHERE {LIVE} AND body IS NOT NULL",
    "soft_fallback": f"""WITH {NODES}, {_bm25('documents', 'doc_id', 'text', 1.5, 0.75, False)}, ntok AS (SELECT unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM node_rows),
a AS (SELECT DISTINCT query_id FROM hit JOIN asked USING (term)), b AS (SELECT DISTINCT query_id FROM ntok JOIN asked USING (term))
SELECT query_id, array_to_string(list_filter([CASE WHEN query_id NOT IN (SELECT query_id FROM a) THEN 'text' END, CASE WHEN query_id NOT IN (SELECT query_id FROM b) THEN 'graph' END], lambda x: x IS NOT NULL), ',') AS missing FROM searched""",
    "cosine_rerank": """
WITH v AS (SELECT doc_id, unit_index, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS e FROM embshim_vector WHERE len(embedding) = 384 AND doc_id IS NOT NULL GROUP BY doc_id, unit_index),
p AS (SELECT doc_id, v.unit_index, e, qe FROM v JOIN (SELECT doc_id, e AS qe FROM v WHERE unit_index = 0) USING (doc_id) WHERE unit_index > 0 AND len(list_filter(e, lambda x: x IS NULL)) = 0 AND len(list_filter(qe, lambda x: x IS NULL)) = 0),
s AS (SELECT doc_id, unit_index, list_dot_product(e, qe) / nullif(sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe)), 0) AS s FROM p)
SELECT doc_id, unit_index, round(s, 6) AS similarity FROM s WHERE s IS NOT NULL AND NOT isnan(s)
""",
}
_OTHER = re.compile(r"\b(asked|tok|stats|hit|dfs|scored|ranked)\b")
_FACT_HITS = _bm25("edge_rows", "write_cursor", "body", 1.5, 0.75, False, extra=f"WHERE {LIVE} AND body IS NOT NULL")
_NAME_HITS = _OTHER.sub(r"\1_n", _bm25("node_rows", "write_cursor", "body", 1.5, 0.75, False, queries="", extra=f"WHERE {VALID}"))


def _fused_by_body(first, second):
    k = {"vector": 1.0, "text": 3.0, "graph": 1.0}
    return f"""fused AS (SELECT query_id, body, round({k[first]} * coalesce(1.0 / (30 + x.rank), 0) + {k[second]} * coalesce(1.0 / (30 + y.rank), 0), 12) AS score, CASE WHEN x.rank IS NOT NULL THEN '{first}' ELSE '{second}' END AS branch, x.rank AS xr, y.rank AS yr
  FROM (SELECT query_id, body, min(rank) AS rank FROM {first}_arm GROUP BY ALL) AS x FULL JOIN (SELECT query_id, body, min(rank) AS rank FROM {second}_arm GROUP BY ALL) AS y USING (query_id, body)),
placed AS (SELECT query_id, body, round(score, 9) AS score, branch, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, xr IS NULL, xr NULLS LAST, yr NULLS LAST, body) AS INTEGER) AS place FROM fused)"""


SQL["hybrid_search"] = f"""WITH RECURSIVE {NODES}, {EDGES}, {_FACT_HITS}{_NAME_HITS},
text_arm AS (SELECT query_id, body, rank FROM ranked JOIN edge_rows ON doc = write_cursor WHERE rank <= 100),
s AS (SELECT query_id, from_id, to_id FROM ranked JOIN edge_rows ON doc = write_cursor WHERE rank <= 10 AND NOT coalesce(temporal_fallback = 1, false)),
start AS (SELECT DISTINCT query_id, logical_id FROM (SELECT query_id, from_id AS logical_id FROM s UNION ALL SELECT query_id, to_id FROM s UNION ALL SELECT query_id, logical_id FROM ranked_n JOIN node_rows ON doc = write_cursor WHERE rank <= 10) WHERE logical_id IN (SELECT logical_id FROM node_rows WHERE state = 'active')),
alive AS (SELECT DISTINCT logical_id AS id FROM node_rows WHERE {VALID}), live AS (SELECT from_id, to_id FROM edge_rows WHERE {LIVE}),
step AS (SELECT DISTINCT a, b FROM (SELECT from_id AS a, to_id AS b FROM live UNION ALL SELECT to_id, from_id FROM live) WHERE b IN (SELECT id FROM alive)),
walk(query_id, id, hop) AS (SELECT query_id, logical_id, 0 FROM start WHERE logical_id IN (SELECT id FROM alive) UNION SELECT query_id, b, hop + 1 FROM walk JOIN step ON a = id WHERE hop < 2),
near AS (SELECT query_id, id, min(hop) AS hop FROM (SELECT * FROM walk UNION ALL SELECT query_id, logical_id, 0 FROM start) GROUP BY query_id, id),
capped AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY hop, id) AS rank FROM near),
graph_arm AS (SELECT query_id, body, rank FROM capped JOIN node_rows ON logical_id = id WHERE rank <= 50 AND body IS NOT NULL),
{_fused_by_body('text', 'graph')} SELECT query_id, body, score, branch, place FROM placed WHERE place <= 10"""
SQL["hybrid_search_vector"] = (
    _phases("label = 3", head=f"WITH {_E.replace('vec_id AS query_id', chr(39) + 'q' + chr(39) + ' || (vec_id // 100 + 1) AS query_id').replace('vec_id % 100 = 0', 'vec_id IN (0, 100, 200, 300)')}")
    + ", "
    + _bm25("(SELECT * FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3))", "doc_id", "text", 1.2, 0.75, False)
    + f""", vector_arm AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS body, rank FROM two WHERE rank <= 10), text_arm AS (SELECT query_id, CAST(doc AS VARCHAR) AS body, rank FROM ranked WHERE rank <= 100),
{_fused_by_body('vector', 'text')} SELECT query_id, body AS doc_id, score, branch, place FROM placed WHERE place <= 10"""
)

SQL = as_integers(SQL, {"rrf_two_arm_weighted": ["place"], "rrf_three_arm": ["place"], "explain_ranks": ["vector_rank", "text_rank"], "score_blend": ["rank"]})
