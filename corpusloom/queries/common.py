"""What several query modules share: the indexed sections and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.postings import postings, read_postings, section_items, write_postings
from corpusloom.session import stored
from corpusloom.sources.tables import table

INDEXED = ["body", "title", "meta.keywords", "meta.description"]
PLAIN = r"replace(lower(regexp_replace(u.sname, '^\s+|\s+$', '', 'g')), '_', '-')"
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

ITEMS = rf"""items AS (SELECT DISTINCT u.url_id AS doc_id, s.secno AS section, u.sval AS text FROM urlinfo u JOIN sections s ON {PLAIN} = s.sname
  WHERE s.sname IN ('body', 'title', 'meta.keywords', 'meta.description') AND u.sval <> '')"""
POST = rf"""{ITEMS},
tok AS (SELECT *, {WORDS} AS w FROM items),
based AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY section, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM tok),
post AS (SELECT doc_id, section, CAST(base + i AS INT) AS pos, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM based) WHERE length(w[i]) BETWEEN 1 AND 32)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    return section_items(table(spark, d, "urlinfo"), table(spark, d, "sections"), INDEXED)


def index(spark: SparkSession, d: str) -> DataFrame:
    """The stored postings of the tables in d, sorted by word. The first query on a version of the tables builds them."""
    path = stored(spark, "index", [table(spark, d, "urlinfo"), table(spark, d, "sections")], lambda p: write_postings(postings(items(spark, d)), p))
    return read_postings(spark, path)


class Registry:
    """Queries and their SQL, filled by a module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = query
        if sql:
            self.sql[name] = sql
