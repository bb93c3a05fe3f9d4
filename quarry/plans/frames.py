"""The engine's frames over the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import table

#: The instant of all queries that have a now.
NOW = 1_300_000_000
NODE_COLUMNS = ["write_cursor", "logical_id", "kind", "body", "source_id", "state", "reason", "valid_from", "valid_until"]
EDGE_COLUMNS = ["write_cursor", "kind", "from_id", "to_id", "source_id", "logical_id", "superseded_at", "body", "t_valid", "t_invalid", "confidence", "extractor_model_id", "temporal_fallback"]
#: Fixed search texts.
SEARCHES = [("q1", "the regional harbour sensor"), ("q2", "federal pension budget in November"), ("q3", "hatchery invoice team"), ("q4", "who are we")]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All node versions, hubs included, rows delivered again once."""
    both = table(spark, sf_dir, "node").select(*NODE_COLUMNS).unionByName(table(spark, sf_dir, "hub_node").select(*NODE_COLUMNS))
    return both.distinct().withColumn("superseded_at", F.lit(None).cast("long"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "edge").select(*EDGE_COLUMNS).distinct()


def searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query_id string, text string")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "article").select("doc_id", "title", "body").distinct()


NODES = f"node_rows AS (SELECT DISTINCT {', '.join(NODE_COLUMNS)} FROM node UNION SELECT DISTINCT {', '.join(NODE_COLUMNS)} FROM hub_node)"
EDGES = f"edge_rows AS (SELECT DISTINCT {', '.join(EDGE_COLUMNS)} FROM edge)"
ARTICLES = "article_rows AS (SELECT DISTINCT doc_id, title, body FROM article)"
LIVE = f"superseded_at IS NULL AND (t_invalid IS NULL OR t_invalid > {NOW})"
VALID = f"state = 'active' AND (valid_from IS NULL OR valid_from <= {NOW}) AND (valid_until IS NULL OR valid_until > {NOW})"
SEARCHED = "searched(query_id, text) AS (VALUES " + ", ".join(f"('{q}', '{t}')" for q, t in SEARCHES) + ")"


def as_integers(sql: dict[str, str], columns: dict[str, list[str]]) -> dict[str, str]:
    """The SQL with the named rank columns as 32-bit integers, which Spark's are."""
    cast = lambda q, cs: f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in cs)}) FROM ({q})"
    return {n: cast(q, columns[n]) if n in columns else q for n, q in sql.items()}
