"""All queries of the subpackage, by name, with SQL where SQL can state the operator."""

from __future__ import annotations

from quarry.plans.registry import Query, collect

MODULES: list[str] = ["p1_queries", "p2_queries", "p3_queries", "p5_queries", "p6_queries", "p7_queries", "p8_queries"]


def everything() -> tuple[dict[str, Query], dict[str, str]]:
    return collect("quarry.llm", MODULES)
