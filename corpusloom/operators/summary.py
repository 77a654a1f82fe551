"""Extractive summaries, language profiles of the core, spelling suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import sentences, sigmoid

# Grams and least sentences of a summary.
GRAM, LEAST_SENTENCES, PICKED = 6, 4, 3


def summaries(texts: DataFrame, most: int = 30, least_chars: int = 20) -> DataFrame:
    """(doc_id, summary): of the longest sentences the three that share most with the others, in order.

    Sentences share an edge by their common 6-grams; the rank of a sentence is the sigmoid of its edges at half output.
    Texts with fewer than four such sentences have none. A text's sentences are at most `most`, so a text's pairs are bounded.
    """
    split = texts.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("at", "s")).filter(F.length("s") >= least_chars)
    one = split.groupBy("doc_id", "s").agg(F.min("at").alias("at"))
    long = one.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("s").desc(), "at"))).filter(F.col("n") <= most)
    per_doc = long.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("all")).filter(F.size("all") >= LEAST_SENTENCES)
    grams = lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - GRAM + 1, F.lit(1))), lambda i: F.substring(F.lower(s), i, F.lit(GRAM))))
    with_grams = per_doc.withColumn("g", F.transform("all", lambda x: grams(x["s"])))
    n = F.size("all")

    def weight(g: Column) -> Column:
        total = F.aggregate("g", F.lit(0), lambda a, o: a + F.size(F.array_intersect(g, o)))
        return (total - F.size(g)) / (2 * 150) / (n + 1)

    ranked = with_grams.withColumn("w", F.transform("g", lambda g: sigmoid(weight(g) * 0.5)))
    best = F.slice(F.sort_array(F.transform(F.arrays_zip("w", "all"), lambda x: F.struct((-x["w"]).alias("d"), x["all"]["at"].alias("at"), x["all"]["s"].alias("s")))), 1, PICKED)
    text = F.array_join(F.transform(F.sort_array(F.transform(best, lambda x: F.struct(x["at"].alias("at"), x["s"].alias("s")))), lambda x: x["s"]), " ")
    return ranked.select("doc_id", text.alias("summary"))


def grams_of(signs: Column, length: int) -> Column:
    """The sequences of so many signs of an array of signs, in one pass (null where it ends)."""
    out = signs
    for k in range(1, length):
        out = F.zip_with(out, F.slice(signs, k + 1, F.greatest(F.size(signs) - k, F.lit(0))), lambda a, b: F.concat(a, b))
    return out


def gram_profiles(texts: DataFrame, key: str, length: int = 3, most: int = 150) -> DataFrame:
    """(key, gram, rank): the most frequent grams of all texts of a key (ties by gram). Counts collapse on the map side."""
    t = F.regexp_replace(F.lower(F.col("text")), r"[^\p{L}]+", " ")
    cut = F.transform(F.array(F.split(t, "")), lambda signs: grams_of(signs, length))[0]  # binds the signs once
    counts = texts.filter("text is not null").select(key, F.explode(cut).alias("gram")).filter(F.length("gram") == length).groupBy(key, "gram").agg(F.count("*").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "gram")))
    return top.filter(F.col("rank") <= most).select(key, "gram", "n", "rank")


def guess(documents: DataFrame, models: DataFrame, length: int = 3, most: int = 150) -> DataFrame:
    """(doc_id, lang): the model (lang, gram, rank) with the least sum of rank differences over a document's profile; a missing gram counts `most`."""
    own = gram_profiles(documents, "doc_id", length, most).select("doc_id", "gram", F.col("rank").alias("r"))
    sizes = own.groupBy("doc_id").agg(F.count("*").alias("grams"))
    near = own.join(F.broadcast(models.select("lang", "gram", F.col("rank").alias("m"))), "gram")  # at most `most` rows a language
    seen = near.groupBy("doc_id", "lang").agg(F.sum(F.abs(F.col("r") - F.col("m"))).alias("diff"), F.count("*").alias("hit"))
    scored = seen.join(sizes, "doc_id").withColumn("distance", F.col("diff") + (F.col("grams") - F.col("hit")) * most)
    return scored.groupBy("doc_id").agg(F.min(F.struct("distance", "lang")).alias("b")).select("doc_id", F.col("b.lang").alias("lang"))


def deletions(word, most: int = 2):
    """A word and all it becomes by taking away up to so many letters, as an array column."""
    def shorter(w):
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return F.when(F.length(w) > 0, cut).otherwise(F.array().cast("array<string>"))

    level = all_ = F.array(word)
    for _ in range(most):
        level = F.flatten(F.transform(level, shorter))
        all_ = F.concat(all_, level)
    return F.array_distinct(all_)


def suggest(words: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """(word, suggestion, distance): the nearest other dictionary word (word, n) within the distance; more frequent ones first.

    Two words within the distance share a form with as many letters taken away, so they meet by an equal join on these forms.
    """
    d = dictionary.select(F.col("word").alias("suggestion"), "n", F.explode(deletions(F.col("word"), most)).alias("form"))
    w = words.select("word").distinct().select("word", F.explode(deletions(F.col("word"), most)).alias("form"))
    near = w.join(d, "form").select("word", "suggestion", "n").distinct()
    near = near.withColumn("distance", F.levenshtein("word", "suggestion")).filter((F.col("distance") <= most) & (F.col("distance") > 0))
    best = near.groupBy("word").agg(F.min(F.struct("distance", (-F.col("n")).alias("m"), "suggestion")).alias("b"))
    return best.select("word", F.col("b.suggestion").alias("suggestion"), F.col("b.distance").alias("distance"))
