"""Fusing, reweighting and reranking ranked lists.

Arms are tables (query_id, body, rank) plus the columns of a hit; every step is windowed by query_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.errors import InvalidArgument

# The fusion constant, the arms' weights and the recency weight.
RRF_K = 30
ARM_WEIGHTS = {"vector": 1.0, "text": 3.0, "graph": 1.0}
RECENCY_WEIGHT = 0.002
ARM_ORDER = ("vector", "text", "graph")


def rank_arm(hits: DataFrame, order: list[Column]) -> DataFrame:
    """1-based ranks within a query."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def fuse(arms: dict[str, DataFrame], k: int = RRF_K, weights: dict[str, float] = ARM_WEIGHTS, digits: int = 12, weigh_confidence: bool = False) -> DataFrame:
    """(query_id, body, score, branch, ranks..., hit columns): reciprocal-rank fusion keyed by body.

    The representative of a body is its hit in the first arm of vector, text, graph; exact ties are ordered by
    that arm, then by the ranks in it and the next.  With ``weigh_confidence`` the graph arm's part is multiplied by the
    confidence of the edge that led to the hit, null being 1.
    """
    trust = lambda n, a: F.coalesce(F.col("confidence"), F.lit(1.0)) if weigh_confidence and n == "graph" and "confidence" in a.columns else F.lit(1.0)
    marked = [a.withColumn("branch", F.lit(n)).withColumn("__arm", F.lit(ARM_ORDER.index(n))).withColumn("__trust", trust(n, a)) for n, a in arms.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    weight = F.create_map(*[F.lit(x) for n in arms for x in (n, float(weights[n]))])
    others = [c for c in rows.columns if c not in ("query_id", "body", "rank", "branch", "__arm", "__trust")]
    best = F.min_by(F.struct("branch", *others), F.struct("__arm", "rank"))
    ranks = [F.min(F.when(F.col("branch") == n, F.col("rank"))).alias(f"{n}_rank") for n in arms]
    # A body that an arm lists twice counts with its best rank there.
    per_arm = rows.groupBy("query_id", "body", "branch", "__arm").agg(F.min("rank").alias("rank"), F.min_by("__trust", "rank").alias("__trust"), F.min_by(F.struct(*others), "rank").alias("r") if others else F.first(F.lit(None)).alias("r"))
    flat = per_arm.select("query_id", "body", "branch", "__arm", "__trust", "rank", *([F.col(f"r.{c}").alias(c) for c in others]))
    total = F.round(F.sum(weight[F.col("branch")] * F.col("__trust") / (k + F.col("rank"))), digits).alias("score")
    return flat.groupBy("query_id", "body").agg(total, best.alias("hit"), F.min("__arm").alias("__arm"), *ranks).select("query_id", "body", "score", "hit.*", *[f"{n}_rank" for n in arms], "__arm")


def fused_order(arms: list[str]) -> list[Column]:
    """The deterministic order of fused hits."""
    return [F.col("score").desc(), F.col("__arm"), *[F.col(f"{n}_rank").asc_nulls_last() for n in ARM_ORDER if n in arms], F.col("body")]


def rrf_unweighted(rankings: DataFrame, k: int = 60, digits: int = 12) -> DataFrame:
    """(query_id, id, score) of rankings (query_id, arm, id, rank): the evaluation library's fusion."""
    return rankings.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), digits).alias("score"))


def min_max(column: str, flat: float = 0.0) -> Column:
    """Scaled to 0..1 over the query's hits; ``flat`` where all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(F.lit(flat))


def with_recency(hits: DataFrame, weight: float = RECENCY_WEIGHT) -> DataFrame:
    return hits.withColumn("score", F.col("score") + weight * min_max("write_cursor"))


def with_importance(hits: DataFrame) -> DataFrame:
    """Score times the node's importance and the edge's confidence, null being neutral."""
    return hits.withColumn("score", F.col("score") * F.coalesce(F.col("importance"), F.lit(1.0)) * F.coalesce(F.col("confidence"), F.lit(1.0)))


def blend(hits: DataFrame, logit: str, alpha: float = 0.3, depth: int = 50) -> DataFrame:
    """``blended`` and the new ``rank``: alpha * sigmoid(logit) + (1 - alpha) * min-max score over the first ``depth``.

    The tail keeps its order below; depth 0 changes nothing; a logit that isn't finite is an error in the scorer
    and leaves its hit without that part.
    """
    if not 0 <= alpha <= 1 or depth < 0:
        raise InvalidArgument(f"alpha {alpha}, depth {depth}")
    if depth == 0:
        return hits.withColumn("blended", F.col("score"))
    pool = Window.partitionBy("query_id", F.col("rank") <= depth)
    low, high = F.min("score").over(pool), F.max("score").over(pool)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0))
    finite = F.col(logit).isNotNull() & ~F.isnan(logit) & (F.abs(F.col(logit)) < float("inf"))
    ce = F.when(finite, 1 / (1 + F.exp(-F.col(logit)))).otherwise(0.0)
    blended = F.when(F.col("rank") <= depth, alpha * ce + (1 - alpha) * scaled)
    mixed = hits.withColumn("blended", F.round(blended, 12)).withColumn("ce_score", F.when(F.col("rank") <= depth, ce))
    order = Window.partitionBy("query_id").orderBy(F.col("blended").desc_nulls_last(), F.col("rank"))
    return mixed.withColumn("old_rank", F.col("rank")).withColumn("rank", F.row_number().over(order))


def identity(logical_id: str = "logical_id", body: str = "body", passage: str | None = None) -> Column:
    """The hit's stable id: l: with a logical id, p: for a passage, else h: and the body's SHA-256."""
    content = F.concat(F.lit("h:"), F.sha2(F.encode(F.col(body), "UTF-8"), 256))
    other = content if passage is None else F.coalesce(F.concat(F.lit("p:"), F.col(passage)), content)
    return F.coalesce(F.concat(F.lit("l:"), F.col(logical_id)), other)


def soft_fallback(arms: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(query_id, missing): the arms that had nothing for a query, before fusion."""
    out = queries.select("query_id")
    for n, a in arms.items():
        out = out.join(a.select("query_id").distinct().withColumn(f"__{n}", F.lit(True)), "query_id", "left")
    gone = [F.when(F.col(f"__{n}").isNull(), F.lit(n)) for n in arms]
    return out.select("query_id", F.array_compact(F.array(*gone)).alias("missing"))
