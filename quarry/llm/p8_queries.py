"""Problem 8: documents that are template residue, filler or error pages."""

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.residue import residue
from quarry.session import table


def p8_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_residue(spark, sf_dir).select("doc_id").distinct()


QUERIES = {"p8_found": p8_found, "p8_residue": p8_residue}
SQL: dict[str, str] = {}
