"""Vector search as the engine does it: exact, two-phase quantised, filtered.

Queries are a table (query_id, q).  Its size is checked: a table within the bound is broadcast against a
scan of the vectors, which each task reduces to its own best k; above the bound it is cut into blocks of
queries that are scanned one after the other, never as one cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.errors import DenseDisabled, InvalidArgument
from quarry.functions.vectors import cosine, dot, hamming, l2, norm, sign_words

#: Queries scanned together.
BLOCK_QUERIES = 2_000
#: Candidates of the first phase, and documents after which the mean is pinned.
PHASE_ONE = 192
PIN_AFTER = 256


def _best(pairs: DataFrame, order: list[Column], k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def scan(vectors: DataFrame, queries: DataFrame, score: Column, order: list[Column], k: int, key: str = "vec_id") -> DataFrame:
    """(query_id, key, score, rank): the best ``k`` rows of ``vectors`` per query, in blocks of queries.

    Only ids and scores are sorted; what else a caller wants of the rows is fetched by key.
    """
    n = queries.count()
    pairs = lambda q: _best(vectors.crossJoin(F.broadcast(q)).select("query_id", key, score.alias("score")), order, k)
    if n <= BLOCK_QUERIES:
        return pairs(queries)
    blocks = -(-n // BLOCK_QUERIES)
    out = None
    for i in range(blocks):
        part = pairs(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i))
        out = part if out is None else out.unionByName(part)
    return out


def knn_l2(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact nearest by Euclidean distance; ties by key."""
    return scan(vectors, queries, l2(F.col(vector), F.col("q")), [F.col("score"), F.col(key)], k, key)


def knn_cosine(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return scan(vectors, queries, cosine(F.col(vector), F.col("q")), [F.col("score").desc(), F.col(key)], k, key)


def quantised(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """``vectors`` with their sign bits."""
    return vectors.withColumn("bits", sign_words(F.col(vector), dim))


def knn_two_phase(vectors: DataFrame, queries: DataFrame, dim: int, k: int, where: Column | None = None, candidates: int = PHASE_ONE, key: str = "vec_id", vector: str = "embedding", bits: str = "bits") -> DataFrame:
    """(query_id, key, score, rank): the nearest of the ``candidates`` closest by sign bits, by exact distance.

    ``where`` is applied before the first phase, so a selective filter still fills the result.  The first phase sorts nothing but
    keys and bits, which ``vectors`` may have in ``bits``; the candidates' vectors are fetched by key.
    """
    rows = vectors if where is None else vectors.filter(where)
    asked = queries.withColumn("q_bits", sign_words(F.col("q"), dim))
    order = [F.col("score"), F.col(key)]
    coded = rows.select(key, F.col(bits).alias("bits")) if bits in vectors.columns else quantised(rows, dim, vector).select(key, "bits")
    near = scan(coded, asked.select("query_id", "q_bits"), hamming(F.col("bits"), F.col("q_bits")), order, candidates, key).select("query_id", key)
    pairs = rows.select(key, F.col(vector).alias("__v")).join(near, key).join(queries.select("query_id", "q"), "query_id")
    return _best(pairs.select("query_id", key, l2(F.col("__v"), F.col("q")).alias("score")), order, k)


def mean_vector(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(pos, mean) per dimension."""
    return vectors.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def pinned_mean(vectors: DataFrame, order: str, after: int = PIN_AFTER, vector: str = "embedding") -> DataFrame:
    """(m): the mean of the first ``after`` vectors, once there are so many; no row before."""
    first = vectors.orderBy(order).limit(after)
    means = mean_vector(first, vector).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("s"))
    enough = first.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= after)
    return means.crossJoin(enough).select(F.transform("s", lambda s: s["mean"]).alias("m"))


def centred(vectors: DataFrame, mean: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vectors`` less the mean (one row, broadcast), as doubles."""
    return vectors.crossJoin(F.broadcast(mean)).withColumn(vector, F.zip_with(F.col(vector).cast("array<double>"), F.col("m"), lambda x, m: x - m)).drop("m")


def recall_at_k(found: DataFrame, truth: DataFrame, key: str = "vec_id") -> DataFrame:
    """(query_id, recall): share of the true rows that were found."""
    hit = found.select("query_id", key).withColumn("hit", F.lit(1))
    return truth.select("query_id", key).join(hit, ["query_id", key], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def pool_passages(scores: DataFrame, doc: str, how: str, score: str = "score") -> DataFrame:
    """(query_id, doc, score): passage scores pooled to documents by max, mean or top2 (mean of the two best)."""
    if how not in ("max", "mean", "top2"):
        raise InvalidArgument(f"no such pooling: {how!r}")
    if how == "top2":
        best = Window.partitionBy("query_id", doc).orderBy(F.col(score).desc())
        scores = scores.withColumn("__r", F.row_number().over(best)).filter("__r <= 2")
    return scores.groupBy("query_id", doc).agg((F.max if how == "max" else F.avg)(score).alias(score))


def hashed_words(docs: DataFrame, doc: str, terms: Column, dim: int) -> DataFrame:
    """(doc, bucket, weight): unit bag-of-words vectors, terms hashed by SHA-1 modulo ``dim``, sparse."""
    # 16**40 doesn't fit a long: fold the digest's five 32-bit words by Horner's rule.
    words = [F.conv(F.substring(F.sha1("term"), 1 + 8 * i, 8), 16, 10).cast("long") for i in range(5)]
    base = (1 << 32) % dim
    bucket = F.lit(0).cast("long")
    for w in words:
        bucket = F.pmod(bucket * base + F.pmod(w, F.lit(dim)), F.lit(dim))
    counts = docs.select(F.col(doc).alias("doc"), F.explode(terms).alias("term")).groupBy("doc", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    size = Window.partitionBy("doc")
    return counts.withColumn("weight", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(size))).select("doc", "bucket", "weight")


def equivalence(stored: DataFrame, fresh: DataFrame, dim: int, key: str = "probe", vector: str = "embedding", most_l2: float = 1e-5, most_flips: int = 0) -> DataFrame:
    """(probe, distance, flips, equivalent): whether an embedder still gives the stored vectors."""
    both = stored.select(key, F.col(vector).alias("a")).join(fresh.select(key, F.col(vector).alias("b")), key)
    d, flips = l2(F.col("a"), F.col("b")), hamming(sign_words(F.col("a"), dim), sign_words(F.col("b"), dim))
    return both.select(key, d.alias("distance"), flips.alias("flips"), ((d <= most_l2) & (flips <= most_flips)).alias("equivalent"))


def require_dense(checked: DataFrame) -> None:
    """Raise if a probe isn't equivalent; text search needs no such check."""
    if not checked.filter("NOT equivalent").isEmpty():
        raise DenseDisabled("the embedder doesn't reproduce the stored probe vectors")


__all__ = ["centred", "cosine", "dot", "equivalence", "hashed_words", "knn_cosine", "knn_l2", "knn_two_phase", "mean_vector", "norm", "pinned_mean", "pool_passages", "quantised", "recall_at_k", "require_dense", "scan"]
