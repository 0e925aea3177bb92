"""All queries of the core library, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from beatloom.plans import analysis_queries, hrv_queries, matching_queries, problems, signal_queries

MODULES = [problems, hrv_queries, signal_queries, matching_queries, analysis_queries]
FLAGSHIP = "h1_time_domain"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
