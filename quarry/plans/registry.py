"""All queries of the core, by name, with the SQL that states the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["time_spans", "text_queries", "vector_queries", "fusion_queries", "read_queries", "graph_queries", "metric_queries"]
FLAGSHIP = "bm25_topk"
Query = Callable[[SparkSession, str], DataFrame]


def collect(package: str, names: list[str]) -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for name in names:
        module = importlib.import_module(f"{package}.{name}")
        if clash := queries.keys() & module.QUERIES.keys():
            raise ValueError(f"query names used twice: {sorted(clash)}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql


def core() -> tuple[dict[str, Query], dict[str, str]]:
    return collect("quarry.plans", MODULES)
