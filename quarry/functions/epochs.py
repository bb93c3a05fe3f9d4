"""Strict ISO-8601 instants to epoch seconds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"


def epoch(text: Column) -> Column:
    """Seconds since 1970 in UTC; null unless the whole text has the shape and is a real instant."""
    whole = F.regexp_replace(text, r"(T\d{2}:\d{2})(Z|[+-]\d{2}:\d{2})?$", "$1:00$2")
    return F.when(text.rlike(SHAPE), F.unix_seconds(F.try_to_timestamp(whole)))


def malformed(text: Column) -> Column:
    return text.isNotNull() & epoch(text).isNull()
