"""Results: order, grouping by site, pages, details of the rows of a page, excerpts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from corpusloom.config import MAX_PAGE_SIZE, PAGE_SIZE
from corpusloom.functions.url import site_key
from corpusloom.session import materialize

# Letters of the sort pattern. Capitals sort downwards.
_SORT = {
    "u": lambda: F.col("doc_id"), "r": lambda: F.col("score"), "p": lambda: F.col("pop_rank"), "d": lambda: F.col("last_mod_time"),
    "i": lambda: F.col("pop_rank") * F.col("score"), "a": lambda: F.col("pop_rank") * 1000 + F.col("score"),
}


def sort_columns(pattern: str = "RP") -> list[Column]:
    """Sort keys of a pattern; the document id settles ties."""
    keys = [(_SORT[ch.lower()]().desc_nulls_last() if ch.isupper() else _SORT[ch]().asc_nulls_last()) for ch in pattern if ch.lower() in _SORT]
    return [*keys, F.col("doc_id").asc()]


def with_rank(rows: DataFrame, pattern: str = "RP") -> DataFrame:
    """Rows with their place in the order of all rows.

    The rows are sorted by ranges, and a place is the row's number in its range and the sizes of the ranges before: no task holds more than a range.
    """
    keys = sort_columns(pattern)
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = materialize(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    before, offsets = 0, {}
    for r in ordered.groupBy("_part").count().orderBy("_part").collect():  # a row a range
        offsets[r["_part"]] = before
        before += r["count"]
    if not offsets:
        return ordered.select(*rows.columns, F.lit(0).cast("bigint").alias("place"))
    base = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    return ordered.withColumn("place", base[F.col("_part")] + F.col("_at") + 1).drop("_part", "_at")


def page(rows: DataFrame, number: int = 1, size: int = PAGE_SIZE, pattern: str = "RP") -> DataFrame:
    """The rows of a page (from 1) with their place: a top-k, then places among those. A page past the end holds the last row."""
    size = max(1, min(size, MAX_PAGE_SIZE))
    number = max(1, number)
    top = rows.orderBy(*sort_columns(pattern)).limit(number * size)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(*sort_columns(pattern)))).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    return placed.filter(F.col("place") > F.least(F.lit((number - 1) * size), F.col("_n") - 1)).drop("_n")


def site_of_row(rows: DataFrame) -> Column:
    """What tells the site of a row: site_id, or where it is null a negative number made of the site's name in url, if there is such a column."""
    if "url" not in rows.columns:
        return F.col("site_id").cast("bigint")
    named = -1 - F.pmod(F.xxhash64(site_key(F.col("url"))), F.lit(1 << 62))
    return F.coalesce(F.col("site_id").cast("bigint"), named)


def group_by_site(rows: DataFrame, pattern: str = "RP") -> DataFrame:
    """The best row of each site with the number of its rows: one aggregate with partial results, so a hot site sends one row a task."""
    keys = [F.when(k.isNull(), F.lit(float("inf"))).otherwise(-k if ch.isupper() else k).cast("double") for ch in pattern if ch.lower() in _SORT for k in [_SORT[ch.lower()]()]]
    best = F.min(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col("doc_id").alias("k"), F.struct(*rows.columns).alias("row")))
    found = rows.groupBy(site_of_row(rows).alias("_site")).agg(best.alias("b"), F.count("*").alias("per_site"))
    return found.select("b.row.*", "per_site")


def group_runs(rows: DataFrame, pattern: str = "RP") -> DataFrame:
    """The first of each run of neighbouring rows of one site in the order of all rows, with the run's length.

    In a run the place and the row's number within its site grow alike, so their difference names it.
    """
    ranked = with_rank(rows, pattern).withColumn("_site", site_of_row(rows))
    runs = ranked.withColumn("_run", F.col("place") - F.row_number().over(Window.partitionBy("_site").orderBy("place")))
    first = F.min(F.struct("place", F.struct(*rows.columns).alias("row"))).alias("b")
    return runs.groupBy("_site", "_run").agg(first, F.count("*").alias("per_site")).select("b.row.*", "b.place", "per_site")


def in_site(rows: DataFrame, pattern: str = "RP") -> DataFrame:
    """Rows with their rank within the site."""
    return rows.withColumn("site_rank", F.row_number().over(Window.partitionBy(site_of_row(rows)).orderBy(*sort_columns(pattern))))


def merge_shards(*shards: DataFrame) -> DataFrame:
    """Rows of shards, one for each document (the best score)."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out.groupBy("doc_id").agg(F.max("score").alias("score"))


def of_label(shards: list[tuple[str, DataFrame]], label: str | None) -> list[DataFrame]:
    """The shards of a label; all of them for none."""
    return [df for name, df in shards if not label or name == label]


def navigation(found: int, number: int, size: int = PAGE_SIZE, around: int = 5) -> dict:
    """Of a result of so many rows: the page shown, the last one, the neighbours, and the numbers of pages around it."""
    last = max(1, -(-found // size))
    now = min(max(1, number), last)
    return {"page": now, "last": last, "previous": now - 1 or None, "next": now + 1 if now < last else None, "pages": list(range(max(1, now - around), min(last, now + around) + 1))}


def details(rows: DataFrame, url: DataFrame) -> DataFrame:
    """Page rows with what url knows of them; only these rows are looked up."""
    return rows.join(url.withColumnRenamed("rec_id", "doc_id"), "doc_id")


def excerpt(text: str | None, terms: list[str], size: int = 256, padding: int = 40) -> str | None:
    """Windows around the terms joined by '...': each begins `padding` before a hit, grows to word edges, and starts where the last ended or later."""
    if not text:
        return text
    low = text.lower()
    hits = sorted({i for t in terms if t for i in _find_all(low, t.lower())})
    if not hits:
        cut = _edge(text, min(size, len(text)))
        return text[:cut] + ("..." if cut < len(text) else "")
    out, end, total, begun = [], 0, 0, -1
    for h in hits:
        start = max(end, h - padding)
        while start > end and not text[start - 1].isspace():
            start -= 1
        stop = _edge(text, min(len(text), max(start, h - padding) + 2 * padding))
        if stop <= end or start == begun:
            continue
        out.append(("..." if start > end else "") + text[start:stop])
        total += stop - start
        begun, end = start, stop
        if total >= size:
            break
    return "".join(out) + ("..." if end < len(text) else "")


def _find_all(low: str, term: str) -> Iterator[int]:
    i = low.find(term)
    while i >= 0:
        before = low[i - 1] if i else " "
        after = low[i + len(term)] if i + len(term) < len(low) else " "
        if not before.isalnum() and not after.isalnum():
            yield i
        i = low.find(term, i + 1)


def _edge(text: str, i: int) -> int:
    while i < len(text) and not text[i].isspace():
        i += 1
    return i


def excerpts(terms: list[str], size: int = 256, padding: int = 40):
    """excerpt as a function of a text column, for the rows of a page."""

    @F.pandas_udf(StringType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: excerpt(t, terms, size, padding), na_action="ignore")

    return run
