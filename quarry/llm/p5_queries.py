"""Problem 5: one ranking per rerank pool from base_score and ce_norm."""

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.ranking import ranking, top
from quarry.session import table

SCORES = ["base_score", "ce_norm"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(table(spark, sf_dir, "rerank_pool"), "qid", "doc_id", SCORES, 5).select("qid", "doc_id")


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking(table(spark, sf_dir, "rerank_pool"), "qid", "doc_id", SCORES).select("qid", "doc_id", "place")


QUERIES = {"p5_found": p5_found, "p5_ranking": p5_ranking}

_RANKED = """
WITH item AS (
  SELECT qid, doc_id, max(CASE WHEN NOT isnan(base_score) THEN base_score END) AS b, max(CASE WHEN NOT isnan(ce_norm) THEN ce_norm END) AS c
  FROM rerank_pool WHERE qid IS NOT NULL AND doc_id IS NOT NULL GROUP BY qid, doc_id
), stood AS (
  SELECT qid, doc_id, percent_rank() OVER (PARTITION BY qid ORDER BY b NULLS FIRST) AS pb, percent_rank() OVER (PARTITION BY qid ORDER BY c NULLS FIRST) AS pc FROM item
), ranked AS (
  SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY least(pb, pc) DESC, greatest(pb, pc) DESC, doc_id) AS place FROM stood
)
"""

SQL = {
    "p5_found": _RANKED + "SELECT qid, doc_id FROM ranked WHERE place <= 5",
    "p5_ranking": _RANKED + "SELECT qid, doc_id, place FROM ranked",
}
