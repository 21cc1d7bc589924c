"""Registered queries by theme, each with its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    from graphloom.queries import architecture, code, edges, language, records, resolution, search, similarity, text, traversal, vectors

    found: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in (language, search, traversal, architecture, code, resolution, edges, text, similarity, vectors, records):
        found |= module.QUERIES
        sql |= module.ORACLES
    return found, sql
