"""Problem 2: the 10 most similar vectors of every usable embshim_vector."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.neighbours import nearest
from quarry.session import table

DIM = 384


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embshim_vector").select("vec_id", "embedding"), "vec_id", "embedding", DIM)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("vec_id"), F.col("neighbour")
    return p2_neighbours(spark, sf_dir).select(F.least(a, b).alias("vec_id_a"), F.greatest(a, b).alias("vec_id_b")).distinct()


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours}
SQL: dict[str, str] = {}
