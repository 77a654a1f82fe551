"""Postings: one row (doc_id, section, pos, word) for each word of each section of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.config import Settings
from corpusloom.functions.names import plain_name
from corpusloom.functions.text import german_spelling, pack_position, strip_accents, words
from corpusloom.session import broadcast_if_small


def section_items(urlinfo: DataFrame, sections: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, section, text): the distinct values of the named sections, laid out by document (the one exchange of an index build)."""
    declared = broadcast_if_small(sections.filter(F.col("sname").isin(names)).select(F.col("sname").alias("n"), F.col("secno").alias("section")))
    rows = urlinfo.filter("sval is not null and sval <> ''").select(F.col("url_id").alias("doc_id"), plain_name(F.col("sname")).alias("n"), F.col("sval").alias("text"))
    return rows.join(declared, "n").select("doc_id", "section", "text").repartition("doc_id").distinct()


def postings(items: DataFrame, settings: Settings = Settings(), token=words) -> DataFrame:
    """Postings of (doc_id, section, text). Positions count from 1 through all sections of a document, in order of section and text.

    A word outside of the length bounds takes a position but no posting.
    """
    own = items.select("doc_id", "section", "text", token(F.col("text")).alias("w"))
    before = Window.partitionBy("doc_id").orderBy("section", "text").rowsBetween(Window.unboundedPreceding, -1)
    based = own.select("doc_id", "section", "w", F.coalesce(F.sum(F.size("w")).over(before), F.lit(0)).alias("base"))
    rows = based.select("doc_id", "section", "base", F.posexplode("w").alias("i", "word"))
    rows = rows.filter(F.length("word").between(settings.min_word, settings.max_word))
    return rows.select("doc_id", "section", (F.col("base") + F.col("i") + 1).cast("int").alias("pos"), "word")


def variants(post: DataFrame, make: Column) -> DataFrame:
    """Extra postings at the same positions where make(word) gives another word."""
    return post.withColumn("other", make).filter("other is not null and other <> word and other <> ''").select("doc_id", "section", "pos", F.col("other").alias("word"))


def accent_variants(post: DataFrame) -> DataFrame:
    return variants(post, strip_accents(F.col("word")))


def german_variants(post: DataFrame) -> DataFrame:
    return variants(post, german_spelling(F.col("word")))


def affix_variants(post: DataFrame, least: int = 3, suffixes: bool = False) -> DataFrame:
    """The prefixes (or suffixes) of each word from `least` letters on, at its position."""
    n = F.length("word")
    cut = F.transform(F.sequence(F.lit(least), n - 1), lambda k: F.substring(F.col("word"), n - k + 1, k) if suffixes else F.substring(F.col("word"), F.lit(1), k))
    return post.filter(n > least).select("doc_id", "section", "pos", F.explode(cut).alias("word"))


def length_bucket(word: Column) -> Column:
    """The table of a word's length, as storage by length has it."""
    n = F.length(word)
    return F.when(n <= 2, 2).when(n <= 12, n).when(n <= 16, 16).otherwise(32)


def packed(post: DataFrame) -> DataFrame:
    """(doc_id, word, intag)."""
    return post.select("doc_id", "word", pack_position(F.col("pos"), F.col("section"), F.length("word")).alias("intag"))


def write_postings(post: DataFrame, path: str, by: str = "word", files: int | None = None) -> None:
    """Write postings for lookup by word: one layout sorted by word, or one folder for each length bucket."""
    if by == "length":
        rows = post.withColumn("bucket", length_bucket(F.col("word"))).repartition("bucket", F.pmod(F.xxhash64("word"), F.lit(files or 16))).sortWithinPartitions("word", "doc_id", "pos")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(path)
    else:
        rows = post.repartitionByRange(files, "word", "doc_id") if files else post.repartitionByRange("word", "doc_id")
        # Small row groups: their least and greatest words let a lookup skip nearly all of a file.
        rows.sortWithinPartitions("word", "doc_id", "pos").write.mode("overwrite").option("parquet.block.size", 8 << 20).option("parquet.page.size", 64 << 10).parquet(path)


def read_postings(spark: SparkSession, path: str, words: list[str] | None = None) -> DataFrame:
    """Stored postings; of the given words only those row groups are read that may hold them."""
    rows = spark.read.parquet(path)
    return rows if words is None else rows.filter(F.col("word").isin(words))


def anchor_postings(anchors: DataFrame) -> DataFrame:
    """Crosswords: words of anchor texts (ref_id, target_id, section, text) as postings of the target, with the page they stand on."""
    rows = anchors.select(F.col("target_id").alias("doc_id"), "ref_id", "section", F.posexplode(words(F.col("text"))).alias("i", "word"))
    return rows.select("doc_id", "ref_id", "section", (F.col("i") + 1).alias("pos"), "word")


def without_stopwords(post: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Postings of words that are in no stop list."""
    return post.join(broadcast_if_small(stopwords.select(F.lower("word").alias("word")).distinct()), "word", "left_anti")


def stopwords_among(stopwords: DataFrame, words: list[str], lang: str | None = None) -> frozenset[str]:
    """Those of some words (of a query, say) that the stop lists hold; lang: only lists whose language begins with it or which it begins with."""
    rows = stopwords.filter(F.lower("word").isin(words))
    if lang:
        rows = rows.filter(F.col("lang").isNull() | F.col("lang").startswith(lang) | F.lit(lang).startswith(F.col("lang")))
    return frozenset(r.w for r in rows.select(F.lower("word").alias("w")).distinct().collect())  # at most the words given


def with_parts(post: DataFrame) -> DataFrame:
    """Postings of loose words, and at the same positions the words that such a word is made of."""
    parts = F.filter(words(F.col("word")), lambda x: x != F.col("word"))
    return post.unionByName(post.select("doc_id", "section", "pos", F.explode(parts).alias("word")))


def content_hashes(items: DataFrame) -> DataFrame:
    """(doc_id, hash): one hash of all distinct section texts of a document; equal contents have equal hashes."""
    own = F.struct("section", F.xxhash64("text").alias("a"), F.md5(F.col("text").cast("binary")).alias("b"))
    ordered = F.array_sort(F.collect_list(own))  # of hashes, not of texts
    return items.groupBy("doc_id").agg(F.md5(F.to_json(ordered).cast("binary")).alias("hash"))


def joined_items(items: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, section, t): the texts of a section joined by blanks, the first one alone where sections (section, single) allow one value."""
    one = broadcast_if_small(sections.select("section", "single"))
    texts = items.join(one, "section").groupBy("doc_id", "section").agg(F.max("single").alias("single"), F.sort_array(F.collect_list("text")).alias("all"))
    return texts.select("doc_id", "section", F.when(F.col("single") == 1, F.col("all")[0]).otherwise(F.array_join("all", " ")).alias("t"))


def within_size(items: DataFrame, most: int, least: int = 0) -> DataFrame:
    """Items (doc_id, section, text) of documents of at least so many characters, in order of section and text until the size limit is reached."""
    n = F.length("text").cast("bigint")
    whole = Window.partitionBy("doc_id")
    before = F.sum(n).over(whole.orderBy("section", "text").rowsBetween(Window.unboundedPreceding, 0)) - n
    return items.withColumn("_whole", F.sum(n).over(whole)).withColumn("_before", before).filter((F.col("_whole") >= least) & (F.col("_before") < most)).drop("_whole", "_before")
