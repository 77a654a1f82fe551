from pyspark.sql import functions as F

from corpusloom.operators import maintenance as m
from corpusloom.operators import popularity, summary
from corpusloom.operators.rules import newest
from corpusloom.session import broadcast_if_small
from corpusloom.streaming.ingest import event_windows, live, posting_batches

URL = "rec_id int, status int, docsize int, crc32 int, site_id int, pop_rank double, shows int"


def test_clones_and_updates(spark):
    url = spark.createDataFrame([(1, 200, 100, 7, 1, 0.1, 0), (2, 200, 105, 7, 1, 0.1, 0), (3, 404, 100, 7, 1, 0.1, 0), (4, 200, 500, 0, None, 0.1, 0), (5, 200, 500, 0, None, 0.1, 0)], URL)
    assert {tuple(r) for r in m.clones(url).collect()} == {(1, 1, 2), (2, 1, 2)}
    assert {r.rec_id: r.status for r in m.mark_clones(url).collect()} == {1: 200, 2: 2200, 3: 404, 4: 200, 5: 200}
    assert {tuple(r) for r in m.origin_of(url, url).collect()} == {(2, 1), (3, 1)}
    t = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (3, "c")], "k int, v string")
    assert {tuple(r) for r in m.update(t, new, ["k"]).collect()} == {(1, "a"), (2, "b")}
    assert {r.k for r in m.add_if_absent(t, new, ["k"]).collect()} == {1, 2, 3}
    assert {r.k for r in m.delete(t, new, ["k"]).collect()} == {1}
    v = spark.createDataFrame([(1, 1, "x"), (1, 3, "y"), (1, 3, "y"), (2, None, "z")], "k int, at int, v string")
    assert {tuple(r) for r in newest(v, ["k"], "at").collect()} == {(1, 3, "y"), (2, None, "z")}


def test_popularity(spark):
    url = spark.createDataFrame([(1, 200, 1, 1, 1, 0.5, 1), (2, 200, 1, 1, 1, 0.5, 0), (3, 200, 1, 1, None, 0.5, 0)], URL)
    links = spark.createDataFrame([(1, 2, 0.05), (1, 2, 0.05), (1, 3, 0.05), (2, 2, 0.05), (3, 9, 0.05), (2, 0, 0.1)], "ot int, k int, weight double")
    servers = spark.createDataFrame([(1, 1.0)], "rec_id int, pop_weight double")
    goo = {r.rec_id: round(r.pop_rank, 6) for r in popularity.goo(url, links, servers).collect()}
    assert goo == {1: 0.01, 2: 0.25, 3: 0.25}
    neo = {r.rec_id: r.pop_rank for r in popularity.neo(url, links).collect()}
    assert set(neo) == {1, 2, 3} and all(0 < v < 1 for v in neo.values())
    assert popularity.neo(url.limit(0), links.limit(0)).count() == 0


def test_summary(spark):
    text = "The bridge over the river is old. The river flows under the old bridge. A cat sleeps in the warm sun today. The old bridge crosses the wide river. Nothing else happened in that village."
    docs = spark.createDataFrame([(1, text), (2, "Too short."), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.summary for r in summary.summaries(docs).collect()}
    assert set(got) == {1} and got[1].count(".") == 3 and "bridge" in got[1]


def test_small_only(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "broadcast" in plan(broadcast_if_small(spark.range(10))).lower()
    assert "broadcast" not in plan(broadcast_if_small(spark.range(10), rows=5)).lower()
    assert "broadcast" not in plan(broadcast_if_small(spark.range(3).select(F.repeat(F.lit("x"), 1000).alias("s")), size=100)).lower()


def test_stream(spark, tmp_path):
    schema = "doc_id int, version int, text string"
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    spark.createDataFrame([(1, 1, "old words"), (2, 1, "stay here"), (1, 2, "new words")], schema).coalesce(1).write.parquet(src)
    posting_batches(spark, src, schema, out, cp).awaitTermination(60)
    spark.createDataFrame([(2, 2, ""), (3, 1, "third")], schema).coalesce(1).write.mode("append").parquet(src)
    posting_batches(spark, src, schema, out, cp).awaitTermination(60)
    assert {(r.doc_id, r.word) for r in live(spark, out).collect()} == {(1, "new"), (1, "words"), (3, "third")}
    events = spark.createDataFrame([("2020-01-01 00:10:00", "q"), ("2020-01-01 00:50:00", "q"), ("2020-01-01 01:10:00", "q")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in event_windows(events).collect()) == [1, 2]
