"""Problem 3: articles that are the same story with small edits."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.near_duplicates import Signature, near_duplicates
from quarry.session import cut, table

LIKE = Signature(words=3, similarity=0.6)
#: Single bits, in segments of which one differs in at most one bit if two signatures differ in at most 7 of 96.
BITS = Signature(words=3, similarity=0.6, segments=4, width=24, bits=1)
#: Members of a group that one task pairs with all others.
MEMBERS = 500


def p3_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that signatures of single bits find: all pairs from about 0.9 on, one in eight at 0.6."""
    return near_duplicates(table(spark, sf_dir, "article").select("doc_id", "body", "ingested_at"), "doc_id", "body", "ingested_at", BITS)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per article with its group."""
    return near_duplicates(table(spark, sf_dir, "article").select("doc_id", "body", "ingested_at"), "doc_id", "body", "ingested_at", LIKE)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different articles within one group, as the problem states its result."""
    members = cut(p3_groups(spark, sf_dir).filter("group_size > 1").select("group_id", F.col("doc_id").alias("doc_id_a"), F.ceil(F.col("group_size") / MEMBERS).alias("parts")))
    # A large group's members are spread over parts, each of which meets all members.
    spread = members.select("group_id", "doc_id_a", F.pmod(F.xxhash64("doc_id_a"), F.col("parts")).alias("part"))
    other = members.select("group_id", F.col("doc_id_a").alias("doc_id_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return spread.join(other, ["group_id", "part"]).filter("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


QUERIES = {"p3_method": p3_method, "p3_found": p3_found, "p3_groups": p3_groups}
SQL: dict[str, str] = {}
