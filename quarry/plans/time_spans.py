"""Problem 4: stated validity of facts as continuous periods and gaps."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.intervals import periods_and_gaps
from quarry.session import table

FACT = ["from_id", "kind", "to_id"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "edge").filter(F.col("superseded_at").isNull())
    return periods_and_gaps(edges, FACT, "t_valid", "t_invalid")


QUERIES = {"p4_found": p4_found}

SQL = {
    "p4_found": """
WITH iv AS (
  SELECT DISTINCT from_id, kind, to_id, t_valid AS s, coalesce(t_invalid, 253402300799) AS e
  FROM edge WHERE superseded_at IS NULL AND t_valid IS NOT NULL AND (t_invalid IS NULL OR t_invalid > t_valid)
), seen AS (
  SELECT *, max(e) OVER (PARTITION BY from_id, kind, to_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM iv
), island AS (
  SELECT *, sum(CASE WHEN reached IS NULL OR s > reached THEN 1 ELSE 0 END) OVER (PARTITION BY from_id, kind, to_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM seen
), period AS (
  SELECT from_id, kind, to_id, min(s) AS s, max(e) AS e FROM island GROUP BY from_id, kind, to_id, g
), gap AS (
  SELECT from_id, kind, to_id, e AS s, lead(s) OVER (PARTITION BY from_id, kind, to_id ORDER BY s) AS e FROM period
)
SELECT from_id, kind, to_id, 'period' AS span, s AS span_start, e AS span_end FROM period
UNION ALL
SELECT from_id, kind, to_id, 'gap' AS span, s AS span_start, e AS span_end FROM gap WHERE e IS NOT NULL
""",
}
