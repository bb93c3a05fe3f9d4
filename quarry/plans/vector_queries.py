"""Vector queries (V1-V18, J12) over embeddings, the label being the source type."""

from pyspark.sql import functions as F

from quarry.functions.text import terms
from quarry.functions.vectors import sign_words
from quarry.operators import evalkit, vector
from quarry.plans.frames import as_integers
from quarry.session import table

DIM = 64


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def _queries(spark, d):
    """The stated query set: vectors whose id is divisible by 100."""
    return _vectors(spark, d).filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def knn_exact_l2(spark, d):
    return vector.knn_l2(_vectors(spark, d), _queries(spark, d), 10).select("query_id", "vec_id", "rank")


def knn_cosine(spark, d):
    return vector.knn_cosine(_vectors(spark, d), _queries(spark, d), 10).select("query_id", "vec_id", "rank")


def sign_quantize(spark, d):
    w = sign_words(F.col("embedding"), DIM)
    return _vectors(spark, d).select("vec_id", w[0].alias("low_bits"), w[1].alias("high_bits"))


def knn_hamming_rerank(spark, d):
    return vector.knn_two_phase(_vectors(spark, d), _queries(spark, d), DIM, 10).select("query_id", "vec_id", "rank")


def knn_filtered(spark, d):
    """The filter comes before both phases, so a rare label still fills the ten."""
    return vector.knn_two_phase(_vectors(spark, d), _queries(spark, d), DIM, 10, F.col("label") == 3).select("query_id", "vec_id", "rank")


def mean_center(spark, d):
    return vector.mean_vector(_vectors(spark, d)).select("pos", F.round("mean", 9).alias("mean"))


def knn_centred(spark, d):
    """Two-phase search after the mean of the first 256 is pinned and subtracted from both sides."""
    rows = _vectors(spark, d)
    mean = vector.pinned_mean(rows, "vec_id")
    asked = vector.centred(_queries(spark, d), mean, "q")
    return vector.knn_two_phase(vector.centred(rows, mean), asked, DIM, 10).select("query_id", "vec_id", "rank")


def recall_at_k(spark, d):
    rows, asked = _vectors(spark, d), _queries(spark, d)
    found = vector.recall_at_k(vector.knn_two_phase(rows, asked, DIM, 10), vector.knn_l2(rows, asked, 10))
    return found.select("query_id", F.round("recall", 6).alias("recall"))


def passage_pool(spark, d):
    """Vectors as passages of documents by id: best two averaged."""
    scored = vector.knn_cosine(_vectors(spark, d), _queries(spark, d), 200).withColumn("doc", F.floor(F.col("vec_id") / 7))
    return vector.pool_passages(scored, "doc", "top2").select("query_id", "doc", F.round("score", 6).alias("score"))


def hashed_embedding(spark, d):
    """Bag-of-words vectors by SHA-1 buckets: the size and the heaviest bucket of each document."""
    w = vector.hashed_words(table(spark, d, "documents"), "doc_id", terms(F.col("text")), 4096)
    return w.groupBy(F.col("doc").alias("doc_id")).agg(F.count(F.lit(1)).alias("buckets"), F.round(F.max("weight"), 9).alias("heaviest"))


def equivalence_probe(spark, d):
    """Each vector against itself with one entry of every tenth negated: those flip and fail."""
    rows = _vectors(spark, d).select(F.col("vec_id").alias("probe"), "embedding")
    bent = rows.withColumn("embedding", F.when(F.col("probe") % 10 == 0, F.transform("embedding", lambda x, i: F.when(i == 0, -x).otherwise(x))).otherwise(F.col("embedding")))
    return vector.equivalence(rows, bent, DIM).select("probe", "flips", "equivalent")


def kmeans_labels(spark, d):
    """Cluster sizes (no SQL counterpart: seeded iteration)."""
    return evalkit.cluster_labels(_vectors(spark, d), "vec_id", "embedding", 8).groupBy("cluster").agg(F.count(F.lit(1)).alias("vectors"))


def mmr_select(spark, d):
    """Ten of the hundred most similar, relevance against redundancy (no SQL counterpart: greedy)."""
    near = vector.knn_cosine(_vectors(spark, d), _queries(spark, d), 100).join(_vectors(spark, d).select("vec_id", "embedding"), "vec_id")
    return evalkit.mmr(near.select("query_id", F.col("vec_id").alias("doc"), F.col("score").alias("rel"), F.col("embedding").alias("vector")), 10)


QUERIES = {f.__name__: f for f in (knn_exact_l2, knn_cosine, sign_quantize, knn_hamming_rerank, knn_filtered, mean_center, knn_centred, recall_at_k, passage_pool, hashed_embedding, equivalence_probe, kmeans_labels, mmr_select)}

_E = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 100 = 0)"
_L2 = "sqrt(list_sum(list_transform(list_zip(e, qe), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
_COS = "list_sum(list_transform(list_zip(e, qe), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(qe, lambda x: x * x))))"


def _word(v, start):
    return f"list_sum(list_transform(range(0, 32), lambda i: CASE WHEN {v}[i + {start} + 1] > 0 THEN cast(1 AS BIGINT) << i ELSE 0 END))::BIGINT"


_HAM = f"(bit_count(xor({_word('e', 0)}, {_word('qe', 0)})) + bit_count(xor({_word('e', 32)}, {_word('qe', 32)})))"


def _phases(where="true", head=f"WITH {_E}", rows="v"):
    return f"""{head}, b AS (SELECT vec_id, e, label, {_word('e', 0)} AS b0, {_word('e', 32)} AS b1 FROM {rows}), qb AS (SELECT query_id, qe, {_word('qe', 0)} AS q0, {_word('qe', 32)} AS q1 FROM q),
near AS (SELECT query_id, vec_id, e, qe, row_number() OVER (PARTITION BY query_id ORDER BY bit_count(xor(b0, q0)) + bit_count(xor(b1, q1)), vec_id) AS r FROM b, qb WHERE {where}),
two AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {_L2}, vec_id) AS rank FROM near WHERE r <= 192)"""


SQL = {
    "knn_exact_l2": f"WITH {_E} SELECT query_id, vec_id, rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {_L2}, vec_id) AS rank FROM v, q) WHERE rank <= 10",
    "knn_cosine": f"WITH {_E} SELECT query_id, vec_id, rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, vec_id) AS rank FROM v, q) WHERE rank <= 10",
    "sign_quantize": f"WITH {_E} SELECT vec_id, {_word('e', 0)} AS low_bits, {_word('e', 32)} AS high_bits FROM v",
    "knn_hamming_rerank": _phases() + "SELECT query_id, vec_id, rank FROM two WHERE rank <= 10",
    "knn_filtered": _phases("label = 3") + "SELECT query_id, vec_id, rank FROM two WHERE rank <= 10",
    "mean_center": f"WITH {_E} SELECT cast(pos AS INTEGER) AS pos, round(avg(x), 9) AS mean FROM (SELECT unnest(e) AS x, unnest(range(0, 64)) AS pos FROM v) GROUP BY pos",
    "knn_centred": _phases(head=f"""WITH {_E.replace('q AS', 'q_raw AS')}, means AS (SELECT list(mean ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS mean FROM (SELECT unnest(e) AS x, unnest(range(0, 64)) AS pos FROM (SELECT e FROM v ORDER BY vec_id LIMIT 256)) GROUP BY pos)),
c AS (SELECT vec_id, label, list_transform(list_zip(e, m), lambda p: p[1] - p[2]) AS e FROM v, means), q AS (SELECT query_id, list_transform(list_zip(qe, m), lambda p: p[1] - p[2]) AS qe FROM q_raw, means)""", rows="c") + "SELECT query_id, vec_id, rank FROM two WHERE rank <= 10",
    "recall_at_k": _phases() + f""", truth AS (SELECT query_id, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {_L2}, vec_id) AS rank FROM v, q) WHERE rank <= 10)
SELECT query_id, round(count(two.vec_id) / count(*), 6) AS recall FROM truth LEFT JOIN (SELECT * FROM two WHERE rank <= 10) AS two USING (query_id, vec_id) GROUP BY query_id""",
    "passage_pool": f"""WITH {_E}, s AS (SELECT query_id, vec_id, {_COS} AS score FROM v, q), near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
best AS (SELECT query_id, vec_id // 7 AS doc, score, row_number() OVER (PARTITION BY query_id, vec_id // 7 ORDER BY score DESC) AS r FROM near WHERE rank <= 200)
SELECT query_id, doc, round(avg(score), 6) AS score FROM best WHERE r <= 2 GROUP BY query_id, doc""",
    "hashed_embedding": """
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
hashed AS (SELECT doc_id, cast(('0x' || substr(sha1(term), 38, 3)) AS BIGINT) % 4096 AS bucket FROM tok),
n AS (SELECT doc_id, bucket, count(*) AS n FROM hashed GROUP BY doc_id, bucket)
SELECT doc_id, count(*) AS buckets, round(max(n) / sqrt(sum(n * n)), 9) AS heaviest FROM n GROUP BY doc_id
""",
    "equivalence_probe": f"WITH {_E} SELECT vec_id AS probe, cast(CASE WHEN vec_id % 10 = 0 AND e[1] <> 0 THEN 1 ELSE 0 END AS INTEGER) AS flips, NOT (vec_id % 10 = 0 AND 2 * abs(e[1]) > 1e-5) AND NOT (vec_id % 10 = 0 AND e[1] <> 0) AS equivalent FROM v",
}

SQL = as_integers(SQL, {"knn_exact_l2": ["rank"], "knn_cosine": ["rank"], "knn_hamming_rerank": ["rank"], "knn_filtered": ["rank"], "knn_centred": ["rank"]})
