from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions.typed import as_boolean, as_double, as_epoch_seconds, as_long, utc_text
from corpusloom.operators.eav import melt, widen

SECTIONS = [("size", 1, 0, "int", 1), ("rate", 2, 0, "double", 1), ("seen", 3, 0, "timestamp", 1), ("on-air", 4, 0, "boolean", 1), ("name", 5, 0, "string", 1), ("tags", 6, 0, "string", 0)]
SCHEMA = "sname string, secno int, maxlen int, valtype string, single int"


def read(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers(spark):
    assert read(spark, as_long, ["12", " 9,975 ", "12 069", "4525 bytes", "+471", "00000195", "NaN", "1,23", "", None, "chunked", "-7", "3.5"]) == [12, 9975, 12069, 4525, 471, 195, None, None, None, None, None, -7, None]
    assert read(spark, as_double, ["2.168", "6,719", "483e-3", " 1.9540 ", "NaN", "?", None]) == [2.168, 6.719, 0.483, 1.954, None, None, None]
    assert read(spark, as_boolean, ["1", "no", "TRUE", "maybe", "", None, "off"]) == [True, False, True, None, None, None, False]


def test_dates(spark):
    texts = ["Sat, 06 Jun 2009 04:19:04 GMT", "2006-12-25T15:46:57Z", "2016-03-05T12:29:03+05:30", "Thursday, 12-Feb-15 14:59:00 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "Sun May 17 10:35:20 2015", "Mon Mar  2 17:19:59 2009", "1230915575", "Mon, 23 Oct 2017 22:42:07 -0500", "2008-13-16 00:00:00", "2009-02-30 00:00:00", "2009-02-03 25:00:00", "yesterday", "", None]
    want = ["2009-06-06 04:19:04", "2006-12-25 15:46:57", "2016-03-05 06:59:03", "2015-02-12 14:59:00", "1994-11-06 08:49:37", "2015-05-17 10:35:20", "2009-03-02 17:19:59", "2009-01-02 16:59:35", "2017-10-24 03:42:07", None, None, None, None, None, None]
    assert read(spark, lambda c: utc_text(as_epoch_seconds(c)), texts) == want
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    try:
        assert read(spark, lambda c: utc_text(as_epoch_seconds(c)), texts) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_wide(spark):
    facts = [(1, "Size ", "1,000", "x"), (1, "size", "1000", "y"), (1, "ON_AIR", "yes", None), (2, "rate", "n/a", ""), (2, "tags", "b", ""), (2, "tags", "a", ""), (2, "tags", "a", ""), (3, "other", "1", ""), (4, None, "1", ""), (5, "size", None, ""), (None, "size", "7", ""), (6, "name", "z", ""), (6, "name", "y", "")]
    wide = widen(spark.createDataFrame(facts, "url_id int, sname string, sval string, e string"), spark.createDataFrame(SECTIONS, SCHEMA))
    got = {r.url_id: r for r in wide.collect()}
    assert set(got) == {1, 2, None, 6}
    assert got[1]["size"] == 1000 and got[1]["on-air"] is True and got[1]["rate"] is None
    assert got[2]["tags"] == ["a", "b"] and got[None]["size"] == 7 and got[6]["name"] == "y"


def test_no_value_disappears(spark):
    facts = [(1, " X_Dro-Mar", "b"), (1, "x-dro-mar", "a"), (1, "x-dro-mar", "a"), (1, "size", "12"), (1, "rate", "n/a"), (2, "other", ""), (3, None, "v"), (None, "other", "w"), (4, "other", None), (5, "tags", "t"), (5, "name", " ")]
    wide = widen(spark.createDataFrame(facts, "url_id int, sname string, sval string"), spark.createDataFrame(SECTIONS, SCHEMA), others=True)
    got = {r.url_id: r for r in wide.collect()}
    assert {k: r.other_names and [(x.name, x["values"]) for x in r.other_names] for k, r in got.items()} == {1: [("rate", ["n/a"]), ("x-dro-mar", ["a", "b"])], 2: [("other", [""])], 3: [(None, ["v"])], None: [("other", ["w"])], 5: [("name", [" "])]}
    assert got[1]["size"] == 12 and got[5]["tags"] == ["t"]
    bare = widen(spark.createDataFrame(facts, "url_id int, sname string, sval string"), spark.createDataFrame([], SCHEMA), others=True)
    assert {r.url_id for r in bare.collect()} == {1, 2, 3, None, 5}


def test_wide_query_keeps_undeclared_names(spark):
    import os

    from corpusloom.functions.names import plain_name
    from corpusloom.queries.eav import p5_wide

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        return
    names = [r[0] for r in spark.read.parquet(f"{d}/sections.parquet").select(plain_name(F.col("sname"))).collect()]
    rows = spark.read.parquet(f"{d}/urlinfo.parquet").filter("sval is not null").select("url_id", plain_name(F.col("sname")).alias("name"), F.col("sval").alias("v")).filter(F.col("name").isNull() | ~F.col("name").isin(names)).distinct()
    got = p5_wide(spark, d).select("url_id", F.explode("other_names").alias("o")).select("url_id", "o.name", F.explode("o.values").alias("v"))
    assert rows.count() > 0 and rows.exceptAll(got).count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "url_id int, sname string, sval string")
    sections = spark.createDataFrame(SECTIONS, SCHEMA)
    assert widen(none, sections).count() == 0
    assert melt(widen(none, sections, valtypes=["int"])).count() == 0
    assert widen(none, spark.createDataFrame([], SCHEMA)).columns == ["url_id"]


def test_hot_entity_and_chunks(spark, monkeypatch):
    monkeypatch.setattr("corpusloom.operators.eav.CHUNK", 5)
    facts = spark.range(3000).selectExpr("cast(if(id % 3 = 0, 1, id) as int) url_id", "'size' sname", "'12' sval")
    wide = widen(facts, spark.createDataFrame(SECTIONS, SCHEMA), valtypes=["int"])
    assert wide.count() == facts.select("url_id").distinct().count() == wide.select("url_id").distinct().count()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 4), st.sampled_from(["size", "SIZE", " size"]), st.one_of(st.none(), st.integers(-50, 50).map(str), st.text(max_size=4))), max_size=30))
def test_against_plain_python(spark, facts):
    want = {}
    for e, _, v in facts:
        if v is not None and v.strip().lstrip("+-").isascii() and v.strip().lstrip("+-").isdigit() and len(v.strip()) - len(v.strip().lstrip("+-")) <= 1:
            want[e] = min(want.get(e, 10**9), int(v.strip()))
    df = spark.createDataFrame(facts, "url_id int, sname string, sval string")
    got = {r.url_id: r["size"] for r in widen(df, spark.createDataFrame(SECTIONS, SCHEMA), valtypes=["int"]).collect()}
    assert got == want
