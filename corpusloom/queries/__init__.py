"""The registered queries and their SQL, by area."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def core() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of all modules here."""
    from corpusloom.queries import eav, pages, search, tables

    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for m in (eav, search, tables, pages):
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
