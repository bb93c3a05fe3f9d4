"""Metric, statistic, source and streaming queries (A5-A24, S10-S11, W3, 2.12)."""

import uuid

from pyspark.sql import functions as F

from quarry.operators import evalkit, fusion, metrics
from quarry.operators.prefix import following
from quarry.plans.frames import NODES, as_integers, nodes
from quarry.plans.fusion_queries import _POOL, _pool, _ranked_pool
from quarry.session import shared_folder, table
from quarry.sources import corpus
from quarry.streaming import projection


def _gold(spark, d):
    """Per pool the documents in the best tenth of ce_norm as required evidence, the next tenth as supporting; pools of class abstain have none."""
    from pyspark.sql.window import Window

    share = F.percent_rank().over(Window.partitionBy("query_id").orderBy(F.col("ce").desc_nulls_last()))
    need = F.when(F.col("p") < 0.1, "required").when(F.col("p") < 0.2, "supporting")
    rows = _pool(spark, d).withColumn("p", share).withColumn("necessity", need).filter("necessity IS NOT NULL AND ce IS NOT NULL")
    return rows.filter("query_class IS NULL OR query_class != 'abstain'").select("query_id", "doc_id", "necessity")


def _classes(spark, d):
    return _pool(spark, d).groupBy("query_id").agg(F.coalesce(F.max("query_class"), F.lit("none")).alias("query_class"))


def evidence_recall_ladder(spark, d):
    return metrics.recall_by_class(metrics.evidence_recall(_ranked_pool(spark, d), _gold(spark, d)), _classes(spark, d), 9)


def hit_mrr_ndcg(spark, d):
    return metrics.hit_mrr_ndcg(_ranked_pool(spark, d), _gold(spark, d).filter("necessity = 'required'"), _classes(spark, d), 10)


def multi_hop_recall(spark, d):
    r = metrics.multi_hop_recall(_ranked_pool(spark, d), _gold(spark, d), 10)
    return r.select("query_id", F.round("recall", 6).alias("recall"), "all_bridges")


def gold_ranks(spark, d):
    return metrics.gold_ranks(_ranked_pool(spark, d), _gold(spark, d))


def abstentions(spark, d):
    """Pools of class abstain, right if their best score is low: what is retrieved above the threshold."""
    ranked = _ranked_pool(spark, d).filter("ce > 0.95")
    return metrics.abstentions(ranked, _classes(spark, d).filter("query_class = 'abstain'"))


def token_f1(spark, d):
    """Node names against the name of the next node of their kind, as answers; a kind of any size is cut into blocks."""
    n = following(nodes(spark, d), ["kind"], ["write_cursor"], ["body"]).withColumnRenamed("next_body", "gold").filter("gold IS NOT NULL")
    return metrics.answer_scores(n, "body", "gold").select("write_cursor", "em", F.round("f1", 6).alias("f1"))


def auc_rank(spark, d):
    """How well base_score tells the documents with a high ce_norm."""
    rows = _pool(spark, d).filter("base IS NOT NULL").withColumn("label", F.coalesce(F.col("ce") >= 0.5, F.lit(False)).cast("int"))
    return metrics.rank_auc(rows, "query_id", "base", "label")


def coverage_prf(spark, d):
    """Documents above 0.5 in ce_norm against the ten best by base_score."""
    gold = _pool(spark, d).filter("ce >= 0.5").select("query_id", "doc_id")
    return metrics.set_scores(gold, _ranked_pool(spark, d).filter("rank <= 10").select("query_id", "doc_id"), "query_id", "doc_id")


def confusion_matrix(spark, d):
    rows = table(spark, d, "documents").withColumn("guess", F.when(F.length("text") > 1000, "long").otherwise("short"))
    return metrics.confusion(rows, "source_type", "guess")


def paired_deltas(spark, d):
    return metrics.paired_deltas(_arm_metrics(spark, d), "base", "ce")


def _arm_metrics(spark, d):
    """Recall at 10 of the required evidence of both orders."""
    gold = _gold(spark, d).filter("necessity = 'required'")
    out = None
    for arm in ("base", "ce"):
        ranked = fusion.rank_arm(_pool(spark, d), [F.col(arm).desc_nulls_last(), F.col("doc_id")])
        one = metrics.multi_hop_recall(ranked, gold, 10).join(_classes(spark, d), "query_id").select("query_id", "query_class", F.lit(arm).alias("arm"), F.col("recall").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def oracle_bound(spark, d):
    return metrics.oracle_bound(_arm_metrics(spark, d))


def win_rates(spark, d):
    m = _arm_metrics(spark, d)
    a, b = m.filter("arm = 'base'").select("query_id", F.col("value").alias("x")), m.filter("arm = 'ce'").select("query_id", F.col("value").alias("y"))
    outcome = F.when(F.col("x") > F.col("y"), "win").when(F.col("x") == F.col("y"), "tie").otherwise("loss")
    return metrics.win_rates(a.join(b, "query_id").select(F.lit("base").alias("arm"), outcome.alias("outcome")))


def win_rate_interval(spark, d):
    """The rate with its interval, outcomes of one query class being one cluster (no SQL counterpart: seeded draws)."""
    m = _arm_metrics(spark, d)
    a, b = m.filter("arm = 'base'").select("query_id", "query_class", F.col("value").alias("x")), m.filter("arm = 'ce'").select("query_id", F.col("value").alias("y"))
    outcome = F.when(F.col("x") > F.col("y"), "win").when(F.col("x") == F.col("y"), "tie").otherwise("loss")
    return evalkit.win_rate_intervals(a.join(b, "query_id").select(F.lit("base").alias("arm"), "query_id", outcome.alias("outcome")), "arm", "query_id", "outcome")


def decision_rule(spark, d):
    facts = oracle_bound(spark, d)
    return metrics.decide(facts, [("go", "best_arm_mean >= 0.9"), ("look", "best_arm_mean >= 0.5")], "no_go").select("query_class", "decision")


def gold_issues(spark, d):
    """Gold with faults put in: supporting evidence twice, documents renamed, required evidence taken out, each by the first digit of the document."""
    gold, digit = _gold(spark, d), F.substring("doc_id", 1, 1)
    broken = gold.filter(~((F.col("necessity") == "required") & digit.isin("0", "1", "2", "3", "4", "5"))).unionByName(gold.filter("necessity = 'supporting'").filter(digit.isin("6", "7")))
    renamed = broken.withColumn("doc_id", F.when(digit == "8", F.concat(F.lit("no-"), "doc_id")).otherwise(F.col("doc_id")))
    return metrics.gold_issues(renamed, table(spark, d, "article"))


def perturbed_ranks(spark, d):
    """First gold rank after gold is put five places lower."""
    return metrics.gold_ranks(metrics.demote_gold(_ranked_pool(spark, d).select("query_id", "doc_id", "rank"), _gold(spark, d), 5), _gold(spark, d))


def percentile_ceil(spark, d):
    out = None
    for p in (0.5, 0.99):
        one = metrics.percentile_ceil(table(spark, d, "events"), "value", p).select(F.lit(p).alias("p"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def perf_regressions(spark, d):
    """Daily mean of event values against the median of the ten days before."""
    runs = table(spark, d, "events").groupBy(F.col("event_type").alias("metric"), F.to_date("ts").alias("run_at")).agg(F.round(F.avg("value"), 6).alias("value"))
    return metrics.regressions(runs).select("metric", "run_at", "regressed")


def bootstrap_ci(spark, d):
    """Seeded intervals of the difference of both orders' recall (no SQL counterpart: seeded draws)."""
    m = _arm_metrics(spark, d).groupBy("query_id", "query_class").agg((F.sum(F.when(F.col("arm") == "base", F.col("value"))) - F.sum(F.when(F.col("arm") == "ce", F.col("value")))).alias("delta"))
    return evalkit.bootstrap(m.filter("delta IS NOT NULL"), "query_class", "query_id", "delta", 7, 200)


def telemetry_gold(spark, d):
    """Views as events and purchases as feedback of a user's session, paired like brackets."""
    e = table(spark, d, "events").filter("event_type IN ('view', 'purchase')")
    ids = F.array(F.col("event_id"))
    log = e.select("event_id", F.when(F.col("event_type") == "view", "event").otherwise("feedback").alias("type"), F.col("user_id").cast("string").alias("query_id"), ids.alias("result_ids"), F.length("props").alias("query_chars"), ids.alias("relevant_ids"), F.lit(None).cast("array<long>").alias("irrelevant_ids"))
    return corpus.gold_records(log, "event_id").select("query_id", F.col("candidate_ids")[0].alias("candidate"), F.map_keys("labels")[0].alias("relevant"))


def telemetry_events(spark, d):
    hits = _ranked_pool(spark, d).filter("rank <= 5").select("query_id", F.length("query_id").alias("query_chars"), F.xxhash64("doc_id").alias("doc"), "rank", F.lit("text").alias("branch"))
    return corpus.telemetry_events(hits).select("query_id", "query_chars", F.size("result_ids").alias("results"), F.size("arm_of").alias("arms"))


def telemetry_arms(spark, d):
    """The arm of every result of an event, by the result's id."""
    hits = _ranked_pool(spark, d).filter("rank <= 5").select("query_id", F.length("query_id").alias("query_chars"), (F.col("rank") * 10).cast("long").alias("doc"), "rank", F.when(F.col("rank") <= 2, "vector").otherwise("text").alias("branch"))
    return corpus.telemetry_events(hits).select("query_id", F.explode("arm_of").alias("result", "arm"))


def _streamed(spark, d):
    """The events file as a stream, and a place for its checkpoint and output in the shared folder."""
    schema = table(spark, d, "events").schema
    return projection.source(spark, f"{d}/events.parquet", schema), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_projection_equals_batch(spark, d):
    """Counts per type derived by micro-batches; the batch's are the same."""
    stream, work = _streamed(spark, d)
    derive = lambda batch: batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total"))
    projection.drain(projection.project(stream, derive, f"{work}/out", f"{work}/checkpoint", f"{work}/failures"))
    return spark.read.parquet(f"{work}/out").groupBy("event_type").agg(F.sum("events").alias("events"), F.round(F.sum("total"), 2).alias("total"))


def stream_latest_state(spark, d):
    """The last event of each (type, user), kept by micro-batches."""
    stream, work = _streamed(spark, d)
    log = stream.select("event_type", "user_id", "event_id", "value")
    projection.drain(projection.latest_state_stream(log, ["event_type", "user_id"], ["event_id"], f"{work}/state", f"{work}/checkpoint"))
    return projection.read_state(spark, f"{work}/state", ["event_type", "user_id"], ["event_id"])


QUERIES = {f.__name__: f for f in (evidence_recall_ladder, hit_mrr_ndcg, multi_hop_recall, gold_ranks, abstentions, token_f1, auc_rank, coverage_prf, confusion_matrix, paired_deltas, oracle_bound, win_rates, win_rate_interval, decision_rule, gold_issues, perturbed_ranks, percentile_ceil, perf_regressions, bootstrap_ci, telemetry_gold, telemetry_events, telemetry_arms, stream_projection_equals_batch, stream_latest_state)}

_CTE = f"""WITH {_POOL}, classes AS (SELECT query_id, coalesce(max(query_class), 'none') AS query_class FROM pool GROUP BY query_id),
shares AS (SELECT *, percent_rank() OVER (PARTITION BY query_id ORDER BY ce DESC NULLS LAST) AS p FROM pool),
gold AS (SELECT query_id, doc_id, CASE WHEN p < 0.1 THEN 'required' ELSE 'supporting' END AS necessity FROM shares WHERE p < 0.2 AND ce IS NOT NULL AND (query_class IS NULL OR query_class <> 'abstain')),
placed AS (SELECT query_id, doc_id, necessity, rank FROM gold JOIN ranked_pool USING (query_id, doc_id))"""
_ARM = """, arms AS (
  SELECT query_id, 'base' AS arm, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY base DESC NULLS LAST, doc_id) AS rank FROM pool
  UNION ALL SELECT query_id, 'ce', doc_id, row_number() OVER (PARTITION BY query_id ORDER BY ce DESC NULLS LAST, doc_id) FROM pool
), m AS (SELECT query_id, query_class, arm, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) AS value FROM gold JOIN arms USING (query_id, doc_id) JOIN classes USING (query_id) WHERE necessity = 'required' GROUP BY ALL)"""
_BOUND = ", b AS (SELECT query_id, query_class, max(value) AS v FROM m GROUP BY ALL), bound AS (SELECT query_class, round(avg(v), 4) AS best_arm_mean FROM b GROUP BY query_class)"
_SQUAD = "list_filter(string_split_regex(regexp_replace(lower({}), '[^a-z0-9 ]+', ' ', 'g'), ' +'), lambda t: t NOT IN ('', 'a', 'an', 'the'))"

SQL = {
    "evidence_recall_ladder": _CTE + """, k AS (SELECT unnest([5, 10, 20, 50]) AS k), c AS (
  SELECT query_id, k, count(*) FILTER (necessity = 'required') AS n, count(*) FILTER (necessity = 'required' AND rank <= k) AS h, count(*) FILTER (necessity = 'supporting') AS sn, count(*) FILTER (necessity = 'supporting' AND rank <= k) AS sh FROM placed, k GROUP BY query_id, k)
SELECT query_class, k, count(*) AS n, round(avg(CASE WHEN h = c.n THEN 1.0 ELSE 0.0 END), 9) AS strict, round(avg(CASE WHEN c.n = 0 THEN 1.0 ELSE h / c.n END), 9) AS graded, round(avg(CASE WHEN sn > 0 THEN sh / sn END), 9) AS supporting FROM c JOIN classes USING (query_id) GROUP BY query_class, k""",
    "hit_mrr_ndcg": _CTE + """, q AS (SELECT query_id, count(*) AS n, count(*) FILTER (rank <= 10) AS h, min(rank) AS f, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM placed WHERE necessity = 'required' GROUP BY query_id)
SELECT query_class, count(*) AS n_scored, round(avg(CASE WHEN CASE WHEN query_class = 'multi_session' THEN h = n ELSE h > 0 END THEN 1.0 ELSE 0.0 END), 4) AS hit, round(avg(1.0 / f), 4) AS mrr, round(avg(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1)))), 4) AS ndcg
FROM q JOIN classes USING (query_id) GROUP BY query_class""",
    "multi_hop_recall": _CTE + "SELECT query_id, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall, count(*) FILTER (rank <= 10) = count(*) AS all_bridges FROM placed GROUP BY query_id",
    "gold_ranks": _CTE + "SELECT query_id, min(rank) AS first_rank, max(rank) AS full_rank FROM placed GROUP BY query_id",
    "abstentions": _CTE + "SELECT query_id, query_id NOT IN (SELECT query_id FROM pool WHERE ce > 0.95) AS abstained FROM classes WHERE query_class = 'abstain'",
    "token_f1": f"""WITH {NODES}, n AS (SELECT write_cursor, body, lead(body) OVER (PARTITION BY kind ORDER BY write_cursor) AS gold FROM node_rows), t AS (SELECT write_cursor, {_SQUAD.format('body')} AS p, {_SQUAD.format('gold')} AS g FROM n WHERE gold IS NOT NULL),
c AS (SELECT *, coalesce(list_sum(list_transform(list_intersect(list_distinct(p), list_distinct(g)), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) AS c FROM t)
SELECT write_cursor, CASE WHEN p = g THEN 1.0::DOUBLE ELSE 0.0 END AS em, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN CASE WHEN p = g THEN 1.0 ELSE 0.0 END WHEN c = 0 THEN 0.0 ELSE 2.0 * c / (len(p) + len(g)) END, 6) AS f1 FROM c""",
    "auc_rank": f"""WITH {_POOL}, r AS (SELECT query_id, coalesce(ce >= 0.5, false) AS y, rank() OVER (PARTITION BY query_id ORDER BY base) + (count(*) OVER (PARTITION BY query_id, base) - 1) / 2 AS r FROM pool WHERE base IS NOT NULL),
s AS (SELECT query_id, sum(r) FILTER (y) AS sr, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM r GROUP BY query_id)
SELECT query_id, CASE WHEN p > 0 AND n > 0 THEN round((sr - p * (p + 1) / 2) / (p * n), 9) END AS auc FROM s""",
    "coverage_prf": f"""WITH {_POOL}, c AS (SELECT count(*) FILTER (ce >= 0.5) AS g, count(*) FILTER (rank <= 10) AS f, count(*) FILTER (ce >= 0.5 AND rank <= 10) AS m FROM ranked_pool)
SELECT g AS gold_items, f AS found_items, m AS matched, round(m / g, 4) AS recall, round(m / f, 4) AS precision FROM c""",
    "confusion_matrix": "SELECT source_type AS truth, CASE WHEN length(text) > 1000 THEN 'long' ELSE 'short' END AS predicted, count(*) AS row_count FROM documents GROUP BY ALL",
    "paired_deltas": _CTE + _ARM + " SELECT query_class, count(*) AS n, round(avg(a.value - b.value), 4) AS delta FROM (SELECT * FROM m WHERE arm = 'base') AS a JOIN (SELECT query_id, value FROM m WHERE arm = 'ce') AS b USING (query_id) GROUP BY query_class",
    "oracle_bound": _CTE + _ARM + _BOUND + " SELECT query_class, best_arm_mean FROM bound",
    "win_rates": _CTE + _ARM + " SELECT 'base' AS arm, count(*) AS n, round(avg(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END), 4) AS win_rate FROM (SELECT * FROM m WHERE arm = 'base') AS a JOIN (SELECT query_id, value FROM m WHERE arm = 'ce') AS b USING (query_id)",
    "decision_rule": _CTE + _ARM + _BOUND + " SELECT query_class, CASE WHEN best_arm_mean >= 0.9 THEN 'go' WHEN best_arm_mean >= 0.5 THEN 'look' ELSE 'no_go' END AS decision FROM bound",
    "gold_issues": _CTE + """, broken AS (SELECT * FROM gold WHERE NOT (necessity = 'required' AND doc_id[1] IN ('0', '1', '2', '3', '4', '5')) UNION ALL SELECT * FROM gold WHERE necessity = 'supporting' AND doc_id[1] IN ('6', '7')),
named AS (SELECT query_id, CASE WHEN doc_id[1] = '8' THEN 'no-' || doc_id ELSE doc_id END AS doc_id, necessity FROM broken)
SELECT 'repeated evidence' AS issue, query_id, doc_id FROM named GROUP BY query_id, doc_id HAVING count(*) > 1 UNION ALL SELECT 'no such document', query_id, doc_id FROM named WHERE doc_id NOT IN (SELECT doc_id FROM article)
UNION ALL SELECT 'nothing required', query_id, NULL FROM named GROUP BY query_id HAVING count(*) FILTER (necessity = 'required') = 0""",
    "perturbed_ranks": _CTE + """, s AS (SELECT r.query_id, r.doc_id, g.doc_id IS NOT NULL AS own, row_number() OVER (PARTITION BY r.query_id ORDER BY rank + CASE WHEN g.doc_id IS NOT NULL THEN 5.5 ELSE 0 END, r.doc_id) AS rank FROM ranked_pool r LEFT JOIN gold g ON g.query_id = r.query_id AND g.doc_id = r.doc_id)
SELECT query_id, min(rank) AS first_rank, max(rank) AS full_rank FROM s WHERE own GROUP BY query_id""",
    "percentile_ceil": "WITH o AS (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT 0.5::DOUBLE AS p, value FROM o WHERE r = ceil(0.5 * n) UNION ALL SELECT 0.99, value FROM o WHERE r = ceil(0.99 * n)",
    "perf_regressions": """WITH runs AS (SELECT event_type AS metric, cast(ts AS DATE) AS run_at, round(avg(value), 6) AS value FROM events GROUP BY ALL)
SELECT metric, run_at, coalesce(value > 1.15 * quantile_cont(value, 0.5) OVER (PARTITION BY metric ORDER BY run_at ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), false) AS regressed FROM runs""",
    "telemetry_events": f"WITH {_POOL} SELECT query_id, cast(length(query_id) AS INTEGER) AS query_chars, cast(count(*) AS INTEGER) AS results, cast(count(*) AS INTEGER) AS arms FROM ranked_pool WHERE rank <= 5 GROUP BY query_id",
    "telemetry_arms": f"WITH {_POOL} SELECT query_id, cast(rank * 10 AS VARCHAR) AS result, CASE WHEN rank <= 2 THEN 'vector' ELSE 'text' END AS arm FROM ranked_pool WHERE rank <= 5",
    "telemetry_gold": """WITH e AS (SELECT event_id, event_type = 'view' AS opens, user_id FROM events WHERE event_type IN ('view', 'purchase') AND user_id IS NOT NULL),
t AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total FROM e),
l AS (SELECT *, least(min(total) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS low FROM t),
o AS (SELECT *, NOT opens AND low < coalesce(lag(low) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS orphan FROM l),
n AS (SELECT user_id, event_id, opens, total - low + CASE WHEN opens THEN 0 ELSE 1 END AS depth FROM o WHERE NOT orphan),
p AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id, depth ORDER BY event_id) AS candidate, lag(opens) OVER (PARTITION BY user_id, depth ORDER BY event_id) AS opened FROM n)
SELECT cast(user_id AS VARCHAR) AS query_id, candidate, event_id AS relevant FROM p WHERE NOT opens AND opened""",
    "stream_latest_state": "SELECT event_type, user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY event_type, user_id",
    "stream_projection_equals_batch": "SELECT event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY event_type",
}

SQL = as_integers(SQL, {"gold_ranks": ["first_rank", "full_rank"], "perturbed_ranks": ["first_rank", "full_rank"]})
