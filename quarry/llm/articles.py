"""The article table as records: one row per doc_id, the last delivered one."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EARLIEST = "0001-01-01 00:00:00"


def latest_where(df: DataFrame, key: str, time: str, condition: Column, *keep: str) -> DataFrame:
    """The last delivered row of each key, if it satisfies ``condition``; (key, *keep).

    Only (key, time) is aggregated over the whole table, with map-side combining; wide columns move
    for rows that satisfy the condition only.  A null time counts as the earliest.  Rows equal in key and
    time count once, whichever comes first in the order of ``keep``.  Rows with a null key are left out.
    """
    t = F.coalesce(F.col(f"`{time}`"), F.lit(_EARLIEST).cast("timestamp"))
    known = df.filter(F.col(f"`{key}`").isNotNull())
    last = known.groupBy(F.col(f"`{key}`").alias("__key")).agg(F.max(t).alias("__last"))
    wide = known.filter(condition).select(F.col(f"`{key}`").alias("__key"), t.alias("__last"), *[F.col(f"`{c}`") for c in keep])
    one = wide.join(last, ["__key", "__last"]).groupBy("__key").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in keep])).alias("__row"))
    return one.select(F.col("__key").alias(key), *[F.col(f"__row.`{c}`").alias(c) for c in keep])
