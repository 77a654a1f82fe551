"""Incremental indexing: a stream of document versions into postings, newest version first to count; and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.operators.rules import newest


def posting_batches(spark: SparkSession, source: str, schema, target: str, checkpoint: str, files_per_batch: int = 16):
    """Start a stream of documents (doc_id, version, text) that appends their postings, with the version, to a table.

    A batch is written under its number, so a repeated batch replaces its own files. live() reads the newest versions.
    """
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def store(batch: DataFrame, number: int) -> None:
        last = newest(batch.select("doc_id", "version", "text"), ["doc_id"], "version")
        rows = last.select("doc_id", "version", F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))
        rows.sortWithinPartitions("word").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(spark: SparkSession, target: str) -> DataFrame:
    """Postings of the newest version of each document; a version without words drops the document."""
    rows = spark.read.parquet(target)
    last = rows.groupBy("doc_id").agg(F.max("version").alias("version"))
    return rows.join(last, ["doc_id", "version"]).filter("word is not null").select("doc_id", "pos", "word")


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of query events by type and window, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
