"""Problem 1: pieces of oversized articles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.articles import latest_where
from quarry.llm.splitting import split_oversized
from quarry.session import table

LIMIT, OVERLAP = 6000, 300


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = latest_where(table(spark, sf_dir, "article"), "doc_id", "ingested_at", F.length("body") > LIMIT, "body")
    return split_oversized(bodies, "doc_id", "body", LIMIT, OVERLAP)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).filter("piece = 0").select("doc_id", "boundary")


QUERIES = {"p1_method": p1_pieces, "p1_found": p1_found, "p1_pieces": p1_pieces}

_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

SQL = {
    "p1_found": rf"""
WITH last AS (
  SELECT doc_id, arg_max(body, ingested_at) AS body FROM article GROUP BY doc_id
), big AS (
  SELECT doc_id, body, string_split_regex(regexp_replace(body, '^([ \t]*\r?\n)+', ''), '\r?\n([ \t]*\r?\n)+') AS paragraphs FROM last WHERE length(body) > {LIMIT}
), cut AS (
  SELECT doc_id, list_max(list_transform(paragraphs, lambda p: length(p))) AS paragraph,
    list_max(list_transform(flatten(list_transform(paragraphs, lambda p: string_split(replace(regexp_replace(p, '([.!?…][\"''”’»›“‘)\]}}」』）】〉》]*){_SPACE}+', '\1' || chr(1), 'g'), '。', '。' || chr(1)), chr(1)))), lambda s: length(s))) AS sentence,
    list_max(list_transform(string_split_regex(body, '{_SPACE}+'), lambda w: length(w))) AS word
  FROM big
)
SELECT doc_id, CASE WHEN paragraph <= {LIMIT} THEN 'paragraph' WHEN sentence <= {LIMIT} THEN 'sentence' WHEN word <= {LIMIT} THEN 'word' ELSE 'none' END AS boundary FROM cut
""",
}
