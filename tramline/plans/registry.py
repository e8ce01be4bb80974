"""All queries of the transit engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramline.plans import fixtures, network_queries, search_queries, timetable_queries

MODULES = (timetable_queries, network_queries, search_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(fixtures.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(fixtures.ORACLES)
