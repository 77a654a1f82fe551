"""Limits of a search: predicates over url, and sets of documents. Values of one parameter are alternatives, parameters all hold."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.names import plain_name


def any_of(conditions: list[Column]) -> Column:
    """An OR; true without conditions."""
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(True)


def like_or_equal(col: Column, values: list[str]) -> Column:
    """Equality, or LIKE where a value holds % or _. Empty values do not count."""
    return any_of([col.like(v) if "%" in v or "_" in v else col == v for v in values if v])


def url_limit(col: Column, values: list[str]) -> Column:
    """A prefix if the value is an absolute URL, else a part."""
    return any_of([col.startswith(v) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", v) else col.contains(v) for v in values if v])


def changed_since(col: Column, now: int, seconds: int) -> Column:
    return col >= now - seconds


def changed_between(col: Column, first_day: str, last_day: str) -> Column:
    """Days in UTC, both included."""
    begin = F.unix_date(F.to_date(F.lit(first_day))).cast("bigint") * 86400
    end = (F.unix_date(F.to_date(F.lit(last_day))).cast("bigint") + 1) * 86400
    return (col >= begin) & (col < end)


def time_bucket(col: Column, seconds: int) -> Column:
    """The start of the hour (3600) or minute (60) in epoch seconds."""
    return F.floor(col / seconds) * seconds


def by_section(urlinfo: DataFrame, name: str, values: list[str]) -> DataFrame:
    """(doc_id) of pages of which a value of the section is as wanted (language, type, tag, category)."""
    rows = urlinfo.filter((plain_name(F.col("sname")) == name) & like_or_equal(F.col("sval"), values))
    return rows.select(F.col("url_id").alias("doc_id")).distinct()


def restrict(rows: DataFrame, *sets: DataFrame) -> DataFrame:
    """Rows whose document is in every set."""
    for s in sets:
        rows = rows.join(s, "doc_id", "left_semi")
    return rows


def section_weights(wf: str, sections: int = 255) -> dict[int, int]:
    """Weights by section of a string of hexadecimal digits read from the right: the last one is of section 1, the first one of all beyond."""
    digits = [int(c, 16) for c in reversed(wf)] or [1]
    return {k + 1: digits[min(k, len(digits) - 1)] for k in range(sections)}


def weighted(post: DataFrame, wf: str) -> DataFrame:
    """Postings whose section has a weight; section 0 (of limits) always stays."""
    none = [k for k, w in section_weights(wf).items() if not w]
    return post.filter(~F.col("section").isin(none)) if none else post


def by_category(urlinfo: DataFrame, categories: DataFrame, path: str) -> DataFrame:
    """(doc_id) of pages whose category value names a category (rec_id, path) at or below a path."""
    below = categories.filter(F.col("path").startswith(path)).select(F.col("rec_id").cast("bigint").alias("c"))
    rows = urlinfo.filter(plain_name(F.col("sname")) == "category").select(F.col("url_id").alias("doc_id"), F.col("sval").try_cast("bigint").alias("c"))
    return rows.join(below, "c", "left_semi").select("doc_id").distinct()


def limit_key(col: Column, kind: str) -> Column:
    """The key of a limit of one's own: hex8str, strcrc32, int, hour, minute, hostname or str2crc32 (by its first two signs)."""
    return {
        "hex8str": lambda: F.rpad(F.lower(col), 16, "0"), "strcrc32": lambda: F.crc32(col.cast("binary")), "int": lambda: col.cast("bigint"), "hour": lambda: F.floor(col / 3600),
        "minute": lambda: F.floor(col / 60), "hostname": lambda: F.crc32(F.lower(F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)).cast("binary")), "str2crc32": lambda: F.crc32(F.substring(col, 1, 2).cast("binary")),
    }[kind]()
