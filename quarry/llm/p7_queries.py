"""Problem 7: documents mixed to the target shares of mix_target, in tokens."""

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.mixing import Mix, mix
from quarry.llm.tokens import sized
from quarry.session import table


def mixed(spark: SparkSession, sf_dir: str) -> Mix:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(sized(documents, "text", "tokens"), "doc_id", "source", "tokens", table(spark, sf_dir, "mix_target"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose constraint the solver found infeasible under their cap."""
    return mixed(spark, sf_dir).report().filter("NOT reachable").select("source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).documents


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).report()


QUERIES = {"p7_method": p7_mix, "p7_found": p7_found, "p7_mix": p7_mix, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
