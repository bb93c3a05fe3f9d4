"""Retrieval and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.errors import InvalidArgument
from quarry.functions.text import squad_tokens
from quarry.operators.prefix import prefix_sum

LADDER = (5, 10, 20, 50)
# Fixed value: classes in which a hit needs the whole gold set.
WHOLE_GOLD = ("multi_session",)


def round4(x: Column) -> Column:
    """Four digits, halves away from zero."""
    return F.round(x, 4)


def evidence_recall(ranked: DataFrame, evidence: DataFrame, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """(query_id, k, strict, graded, supporting): per query with evidence (query_id, doc_id, necessity).

    Denominators are distinct required documents; strict is all of them, 1 when there are none; supporting
    is null for a query without supporting evidence.
    """
    unique = evidence.select("query_id", "doc_id", "necessity").distinct()
    best = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    found = unique.join(best, ["query_id", "doc_id"], "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ladder])))
    hit = F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))
    need, help_ = F.col("necessity") == "required", F.col("necessity") == "supporting"
    c = found.groupBy("query_id", "k").agg(F.count_if(need).alias("n"), F.count_if(need & hit).alias("h"), F.count_if(help_).alias("sn"), F.count_if(help_ & hit).alias("sh"))
    return c.select("query_id", "k", F.when(F.col("h") == F.col("n"), 1.0).otherwise(0.0).alias("strict"), F.when(F.col("n") == 0, 1.0).otherwise(F.col("h") / F.col("n")).alias("graded"), F.when(F.col("sn") > 0, F.col("sh") / F.col("sn")).alias("supporting"))


def recall_by_class(per_query: DataFrame, classes: DataFrame, digits: int = 4) -> DataFrame:
    """(query_class, k, n, strict, graded, supporting): means; supporting over the queries that have any."""
    return per_query.join(classes, "query_id").groupBy("query_class", "k").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), digits).alias(c) for c in ("strict", "graded", "supporting")])


def abstentions(ranked: DataFrame, negatives: DataFrame) -> DataFrame:
    """(query_id, abstained): a negative query is right if nothing was retrieved."""
    some = ranked.select("query_id").distinct().withColumn("__some", F.lit(True))
    return negatives.select("query_id").join(some, "query_id", "left").select("query_id", F.col("__some").isNull().alias("abstained"))


def hit_mrr_ndcg(ranked: DataFrame, gold: DataFrame, classes: DataFrame, k: int = 10) -> DataFrame:
    """(query_class, n_scored, hit, mrr, ndcg): binary relevance; queries without gold are left out.

    In classes of whole gold sets a hit needs all of it.
    """
    unique = gold.select("query_id", "doc_id").distinct()
    best = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    found = unique.join(best, ["query_id", "doc_id"], "left")
    within = F.coalesce(F.col("rank") <= k, F.lit(False))
    one = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(within).alias("h"), F.min("rank").alias("first"), F.sum(F.when(within, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    scored = one.join(classes, "query_id")
    whole = F.col("query_class").isin(*WHOLE_GOLD)
    hit = F.when(F.when(whole, F.col("h") == F.col("n")).otherwise(F.col("h") > 0), 1.0).otherwise(0.0)
    return scored.groupBy("query_class").agg(F.count(F.lit(1)).alias("n_scored"), round4(F.avg(hit)).alias("hit"), round4(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0)))).alias("mrr"), round4(F.avg(F.col("dcg") / ideal)).alias("ndcg"))


def multi_hop_recall(ranked: DataFrame, bridges: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, all_bridges): share of the supporting documents within ``k``, and whether all are."""
    found = bridges.select("query_id", "doc_id").distinct().join(ranked.filter(F.col("rank") <= k).select("query_id", "doc_id").distinct().withColumn("__hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return found.groupBy("query_id").agg((F.count("__hit") / F.count(F.lit(1))).alias("recall"), (F.count("__hit") == F.count(F.lit(1))).alias("all_bridges"))


def gold_ranks(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, first_rank, full_rank): where the first gold is, and where the last is if all are there."""
    found = gold.select("query_id", "doc_id").distinct().join(ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")), ["query_id", "doc_id"], "left")
    return found.groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.when(F.count("rank") == F.count(F.lit(1)), F.max("rank")).alias("full_rank"))


def answer_scores(answers: DataFrame, prediction: str = "prediction", gold: str = "gold") -> DataFrame:
    """``answers`` with ``em`` and ``f1``: exact match and token overlap with multiplicity after normalisation."""
    p, g = squad_tokens(F.col(prediction)), squad_tokens(F.col(gold))
    marked = answers.withColumn("__p", F.coalesce(p, F.array().cast("array<string>"))).withColumn("__g", F.coalesce(g, F.array().cast("array<string>")))
    common = F.aggregate(F.array_intersect("__p", "__g"), F.lit(0), lambda s, t: s + F.least(F.size(F.filter("__p", lambda x: x == t)), F.size(F.filter("__g", lambda x: x == t))))
    counted = marked.withColumn("__c", common)
    precision, recall = F.col("__c") / F.size("__p"), F.col("__c") / F.size("__g")
    empty = (F.size("__p") == 0) | (F.size("__g") == 0)
    same = F.col("__p") == F.col("__g")
    f1 = F.when(F.col(prediction).isNull(), 0.0).when(empty, F.when(same, 1.0).otherwise(0.0)).when(F.col("__c") == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return counted.withColumn("em", F.when(F.col(prediction).isNotNull() & same, 1.0).otherwise(0.0)).withColumn("f1", f1).drop("__p", "__g", "__c")


def rank_auc(scored: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """(group, auc): probability that a positive scores above a negative, ties half; null without both.

    Works on counts per distinct score, so a group of any size is aggregated before its scores are ordered.
    """
    c = scored.groupBy(group, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    upto = prefix_sum(c, [group], [score], F.col("n"), "upto")
    u = upto.withColumn("u", F.col("p") * (F.col("upto") - F.col("n") / 2))
    return u.groupBy(group).agg(F.when((F.sum("p") > 0) & (F.sum("n") > 0), F.round(F.sum("u") / (F.sum("p").cast("double") * F.sum("n")), 9)).alias("auc"))


def set_scores(gold: DataFrame, found: DataFrame, doc: str, item: str) -> DataFrame:
    """(gold_items, found_items, matched, recall, precision): micro sums over documents of item sets."""
    g, f = gold.select(doc, item).distinct().withColumn("__g", F.lit(1)), found.select(doc, item).distinct().withColumn("__f", F.lit(1))
    s = g.join(f, [doc, item], "full").agg(F.count("__g").alias("gold_items"), F.count("__f").alias("found_items"), F.count_if(F.col("__g").isNotNull() & F.col("__f").isNotNull()).alias("matched"))
    ratio = lambda n: F.when(F.col(n) > 0, round4(F.col("matched") / F.col(n))).otherwise(0.0)
    return s.withColumn("recall", ratio("gold_items")).withColumn("precision", ratio("found_items"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, row_count)."""
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("row_count"))


def paired_deltas(metrics: DataFrame, arm_a: str, arm_b: str) -> DataFrame:
    """(query_class, n, delta): mean of a's metric less b's over the queries both have, of (query_id, query_class, arm, value)."""
    a = metrics.filter(F.col("arm") == arm_a).select("query_id", "query_class", F.col("value").alias("x"))
    b = metrics.filter(F.col("arm") == arm_b).select("query_id", F.col("value").alias("y"))
    return a.join(b, "query_id").groupBy("query_class").agg(F.count(F.lit(1)).alias("n"), round4(F.avg(F.col("x") - F.col("y"))).alias("delta"))


def win_rates(verdicts: DataFrame) -> DataFrame:
    """(arm, n, win_rate) of (arm, outcome): a tie is half a win."""
    value = F.when(F.col("outcome") == "win", 1.0).when(F.col("outcome") == "tie", 0.5).otherwise(0.0)
    return verdicts.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), round4(F.avg(value)).alias("win_rate"))


def oracle_bound(metrics: DataFrame) -> DataFrame:
    """(query_class, best_arm_mean): what choosing the best arm for each query would give."""
    return metrics.groupBy("query_id", "query_class").agg(F.max("value").alias("best")).groupBy("query_class").agg(round4(F.avg("best")).alias("best_arm_mean"))


def tuning_sweep(pool: DataFrame, gold: DataFrame, pools: list[int], alphas: list[float], k: int) -> DataFrame:
    """(pool_n, alpha, recall): strict recall at ``k`` of each reranking setting over (query_id, doc_id, rank, base, ce).

    The grid is a literal array, so no table is crossed.
    """
    grid = F.array(*[F.struct(F.lit(p).alias("pool_n"), F.lit(float(a)).alias("alpha")) for p in pools for a in alphas])
    rows = pool.select("query_id", "doc_id", "rank", "base", "ce", F.explode(grid).alias("g")).select("query_id", "doc_id", "rank", "base", "ce", "g.*").filter(F.col("rank") <= F.col("pool_n"))
    w = Window.partitionBy("query_id", "pool_n", "alpha")
    low, high = F.min("base").over(w), F.max("base").over(w)
    scaled = F.when(high > low, (F.col("base") - low) / (high - low)).otherwise(1.0)
    score = F.round(F.col("alpha") * F.coalesce("ce", F.lit(0.0)) + (1 - F.col("alpha")) * scaled, 12)
    placed = rows.withColumn("score", score).withColumn("new_rank", F.row_number().over(w.orderBy(F.col("score").desc(), "rank", "doc_id")))
    wanted = gold.select("query_id", "doc_id").distinct()
    n = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = placed.join(wanted, ["query_id", "doc_id"]).groupBy("query_id", "pool_n", "alpha").agg(F.count_if(F.col("new_rank") <= k).alias("h"))
    settings = n.withColumn("g", F.explode(grid)).select("query_id", "n", "g.*")
    return settings.join(hits, ["query_id", "pool_n", "alpha"], "left").groupBy("pool_n", "alpha").agg(round4(F.avg(F.when(F.coalesce("h", F.lit(0)) == F.col("n"), 1.0).otherwise(0.0))).alias("recall"))


def demote_gold(ranked: DataFrame, gold: DataFrame, by: int) -> DataFrame:
    """Rankings in which gold documents stand ``by`` places lower."""
    marked = ranked.join(gold.select("query_id", "doc_id").distinct().withColumn("__gold", F.lit(True)), ["query_id", "doc_id"], "left")
    shifted = F.col("rank") + F.when(F.col("__gold"), F.lit(by + 0.5)).otherwise(0.0)
    return marked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(shifted, "doc_id"))).drop("__gold")


def inject(ranked: DataFrame, distractors: DataFrame) -> DataFrame:
    """Rankings with distractors (query_id, doc_id, rank) put in at their places; others move down."""
    both = ranked.withColumn("__own", F.lit(1)).unionByName(distractors.withColumn("__own", F.lit(0)))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "__own", "doc_id"))).drop("__own")


def percentile_ceil(rows: DataFrame, value: str, p: float) -> DataFrame:
    """(value): the order statistic at ceil(p n), found on counts per distinct value."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n")).withColumn("__all", F.lit(0))
    upto = prefix_sum(counts, ["__all"], [value], F.col("__n"), "__upto")
    return upto.crossJoin(F.broadcast(counts.agg(F.sum("__n").alias("__total")))).filter(F.col("__upto") >= F.ceil(F.lit(p) * F.col("__total"))).agg(F.min(value).alias(value))


def check_depth(k: int, limit: int) -> None:
    """A metric at ``k`` can't be measured on rankings cut at a smaller limit."""
    if k > limit:
        raise InvalidArgument(f"recall at {k} can't be measured on {limit} results")


def gold_issues(gold: DataFrame, documents: DataFrame) -> DataFrame:
    """(issue, query_id, doc_id): repeated evidence, evidence without document, queries without required evidence."""
    twice = gold.groupBy("query_id", "doc_id").count().filter("count > 1").select(F.lit("repeated evidence").alias("issue"), "query_id", "doc_id")
    lost = gold.join(documents.select("doc_id").distinct(), "doc_id", "left_anti").select(F.lit("no such document").alias("issue"), "query_id", "doc_id")
    none = gold.groupBy("query_id").agg(F.count_if(F.col("necessity") == "required").alias("n")).filter("n = 0").select(F.lit("nothing required").alias("issue"), "query_id", F.lit(None).cast("string").alias("doc_id"))
    return twice.unionByName(lost).unionByName(none)


def decide(facts: DataFrame, rules: list[tuple[str, str]], otherwise: str) -> DataFrame:
    """``facts`` with ``decision``: the token of the first rule (token, SQL condition) that holds."""
    out: Column | None = None
    for token, condition in rules:
        out = F.when(F.expr(condition), token) if out is None else out.when(F.expr(condition), token)
    return facts.withColumn("decision", F.lit(otherwise) if out is None else out.otherwise(otherwise))


def regressions(runs: DataFrame, window: int = 10, slower: float = 1.15) -> DataFrame:
    """(metric, run_at, value, baseline, regressed): each run against the median of the ten before it."""
    before = Window.partitionBy("metric").orderBy("run_at").rowsBetween(-window, -1)
    base = F.percentile("value", F.lit(0.5)).over(before)
    return runs.withColumn("baseline", base).withColumn("regressed", F.coalesce(F.col("value") > F.col("baseline") * slower, F.lit(False)))
