"""Problem 6: documents packed into containers of 4,096 tokens."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.packing import pack
from quarry.llm.tokens import sized
from quarry.session import table

CAPACITY = 4096


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(sized(documents, "text", "tokens"), "doc_id", "tokens", CAPACITY)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing had to cut."""
    return p6_packing(spark, sf_dir).filter("piece = 1").select("doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by how full they are, in tenths of the capacity."""
    filled = p6_packing(spark, sf_dir).groupBy("container").agg(F.sum(F.col("size_end") - F.col("size_start")).alias("used"))
    tenth = F.least(F.floor(F.col("used") * 10 / CAPACITY), F.lit(9)).alias("tenth")
    return filled.groupBy(tenth).agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.sum(CAPACITY - F.col("used")).alias("unused"))


QUERIES = {"p6_method": p6_packing, "p6_found": p6_found, "p6_packing": p6_packing, "p6_fill": p6_fill}
SQL: dict[str, str] = {}
