"""Upkeep of the tables: targets, clones, updates, deletions, statistics, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.config import CLONE_STATUS


def targets(url: DataFrame, now: int, most: int, *order: Column, where: Column | None = None) -> DataFrame:
    """The next pages to visit: due ones, in order (default: popular, few hops, longest due), as a top-k."""
    due = url.filter(F.col("next_index_time") <= now)
    keys = order or (F.col("pop_rank").desc(), F.col("hops").asc(), F.col("next_index_time").asc())
    return (due if where is None else due.filter(where)).orderBy(*keys, F.col("rec_id").asc()).limit(most)


def postpone(url: DataFrame, condition: Column, until: int | Column) -> DataFrame:
    """url with next_index_time set where the condition holds (marking, reindexing, errors of a site)."""
    return url.withColumn("next_index_time", F.when(condition, until).otherwise(F.col("next_index_time")))


def statistics(url: DataFrame, now: int) -> DataFrame:
    """By status: pages, due ones, and their sizes."""
    due = F.col("next_index_time") <= now
    return url.groupBy("status").agg(F.count("*").alias("total"), F.sum(due.cast("int")).alias("expired"), F.sum("docsize").alias("size"), F.sum(F.when(due, F.col("docsize")).otherwise(0)).alias("expired_size"))


def clones(url: DataFrame) -> DataFrame:
    """(rec_id, origin, clones): pages in the index with the same content hash as another, the least id as origin."""
    own = url.filter((F.col("crc32") != 0) & F.col("status").isin(200, 206, 304, 2200, 2206, 2304)).select("rec_id", "crc32")
    groups = own.groupBy("crc32").agg(F.min("rec_id").alias("origin"), F.count("*").alias("clones")).filter("clones > 1")
    return own.join(groups, "crc32").select("rec_id", "origin", "clones")


def mark_clones(url: DataFrame) -> DataFrame:
    """url with the status of clones raised; origins keep theirs."""
    found = clones(url).filter("rec_id <> origin").select("rec_id", F.lit(True).alias("clone"))
    raised = F.when(F.col("clone") & (F.col("status") < CLONE_STATUS), F.col("status") + CLONE_STATUS).otherwise(F.col("status"))
    return url.join(found, "rec_id", "left").withColumn("status", raised).drop("clone").select(url.columns)


def origin_of(new: DataFrame, url: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(rec_id, origin): for new pages the least known page of the same hash and of a size within the tolerance."""
    known = url.filter("crc32 <> 0").select(F.col("rec_id").alias("origin"), "crc32", F.col("docsize").alias("size"))
    near = new.filter("crc32 <> 0").join(known, "crc32").filter((F.col("origin") < F.col("rec_id")) & (F.abs(F.col("docsize") - F.col("size")) <= tolerance * F.col("size")))
    return near.groupBy("rec_id").agg(F.min("origin").alias("origin"))


def add_if_absent(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with those rows, one for each key, whose key it lacks."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(table.columns))


def update(table: DataFrame, changes: DataFrame, key: list[str], nulls: bool = False) -> DataFrame:
    """The table with the values of changes (one row a key): those not null, or with nulls=True all of them."""
    if nulls:
        new = changes.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"new_{c}") for c in changes.columns if c not in key])
        joined = table.join(new, key, "left")
        return joined.select([F.when(F.col("_hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns and c not in key else F.col(c) for c in table.columns])
    new = changes.select(*key, *[F.col(c).alias(f"new_{c}") for c in changes.columns if c not in key])
    joined = table.join(new, key, "left")
    return joined.select([F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in changes.columns and c not in key else F.col(c) for c in table.columns])


def delete(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """The table without the rows whose key is in gone."""
    return table.join(gone.select(*key).distinct(), key, "left_anti")


def clear(tables: dict[str, tuple[DataFrame, str]], pages: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables, each with its column of page ids, without the pages (rec_id) of a limit; without any row if there is no limit."""
    if pages is None:
        return {name: df.limit(0) for name, (df, _) in tables.items()}
    return {name: delete(df, pages.select(F.col("rec_id").alias(column)), [column]) for name, (df, column) in tables.items()}


def clone_ranks(url: DataFrame) -> DataFrame:
    """(crc32, clones, top_rank): of each content that several pages hold, their number and greatest popularity."""
    own = url.filter((F.col("crc32") != 0) & F.col("status").isin(200, 206, 304, 2200, 2206, 2304))
    return own.groupBy("crc32").agg(F.count("*").alias("clones"), F.max("pop_rank").alias("top_rank")).filter("clones > 1")


def without_clones(post: DataFrame, url: DataFrame) -> DataFrame:
    """Postings without those of marked clones."""
    return post.join(url.filter(F.col("status") >= CLONE_STATUS).select(F.col("rec_id").alias("doc_id")), "doc_id", "left_anti")


def find_by_url(url: DataFrame, addresses: DataFrame) -> DataFrame:
    """(url, rec_id) of the addresses (url) that are known."""
    return addresses.select("url").distinct().join(url.select("url", "rec_id"), "url")


def tracked(searches: list[tuple[str, DataFrame]], when: int, seconds: float = 0.0) -> DataFrame:
    """The query log of searches (words, their documents): (qwords, qtime, wtime, found), one row each, even without hits."""
    out = None
    for words, hits in searches:
        row = hits.agg(F.count("*").alias("found")).select(F.lit(words).alias("qwords"), F.lit(when).alias("qtime"), F.lit(int(seconds * 1000)).alias("wtime"), "found")
        out = row if out is None else out.unionByName(row)
    return out


def running_sums(rows: DataFrame, key: str, order: str, value: Column, width: int = 1 << 12) -> DataFrame:
    """rows with so_far: the sum of value up to and including the row, by key in the order of a whole number.

    Sums of stretches of the order come first, so that a key with any share of the rows is spread over its stretches.
    """
    cut = rows.withColumn("_v", value).withColumn("_cut", F.floor(F.col(order) / width))
    stretch = cut.groupBy(key, "_cut").agg(F.sum("_v").alias("_s"))
    base = stretch.select(F.col(key).alias("_k"), F.col("_cut").alias("_c"), (F.sum("_s").over(Window.partitionBy(key).orderBy("_cut")) - F.col("_s")).alias("_base"))
    joined = cut.join(base, F.col(key).eqNullSafe(F.col("_k")) & F.col("_cut").eqNullSafe(F.col("_c")))
    inside = F.sum("_v").over(Window.partitionBy(key, "_cut").orderBy(order))
    return joined.withColumn("so_far", F.col("_base") + inside).drop("_v", "_cut", "_k", "_c", "_base")


def live_postings(post: DataFrame, deletions: DataFrame) -> DataFrame:
    """Postings (doc_id, stamp, ...) that are newer than the deletion (doc_id, stamp) of their document."""
    last = deletions.groupBy("doc_id").agg(F.max("stamp").alias("gone"))
    return post.join(last, "doc_id", "left").filter("gone is null or stamp > gone").drop("gone")


def orphans(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Keys of one store that the other lacks."""
    return left.select(key).distinct().join(right.select(F.col(other).alias(key)).distinct(), key, "left_anti")


def changed(old: DataFrame, new: DataFrame, key: str = "rec_id") -> DataFrame:
    """(key, changed): whether the hash of a page differs from the last snapshot; pages without one have changed."""
    before = old.select(key, F.col("crc32").alias("before"))
    return new.join(before, key, "left").select(key, (F.col("before").isNull() | (F.col("before") != F.col("crc32"))).alias("changed"))


def referrers(url: DataFrame) -> DataFrame:
    """(status, url, referrer): pages with the page that led to them."""
    by = url.select(F.col("rec_id").alias("referrer"), F.col("url").alias("referrer_url"))
    return url.filter("referrer <> 0 and referrer <> rec_id").join(by, "referrer").select("rec_id", "status", "url", "referrer_url")


def bad_links(url: DataFrame, links: DataFrame, now: int, age: int) -> DataFrame:
    """(src, dst) of links from pages that have failed (400 to 1999) for longer than age."""
    bad = url.filter(F.col("status").between(400, 1999) & (F.col("bad_since_time") < now - age)).select(F.col("rec_id").alias("src"))
    return links.select(F.col("ot").alias("src"), F.col("k").alias("dst")).distinct().join(bad, "src", "left_semi")


def valid_links(links: DataFrame) -> DataFrame:
    """Links that are not marked invalid, one row for each pair with its greatest weight."""
    return links.filter("valid is null or valid = 't'").groupBy("ot", "k").agg(F.max("weight").alias("weight"))


def sitemap(url: DataFrame) -> DataFrame:
    """(loc, lastmod, priority) of pages in the index, priority by the place of pop_rank between least and greatest."""
    s = F.col("status")
    own = url.filter((s == 0) | s.between(200, 399) | s.between(2200, 2399))
    ends = own.agg(F.min("pop_rank").alias("lo"), F.max("pop_rank").alias("hi"))
    priority = (F.col("pop_rank") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-5)
    return own.join(F.broadcast(ends)).select(F.col("url").alias("loc"), "last_mod_time", F.round(priority, 6).alias("priority"))  # one row


def term_counts(post: DataFrame, words: list[str]) -> DataFrame:
    """(word, hits, documents) of query words."""
    return post.filter(F.col("word").isin(words)).groupBy("word").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("documents"))
