"""Every registered core query against its SQL, on whole small tables."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.queries import core

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = core()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, datetime.datetime):
        v = v.replace(tzinfo=None)
    return repr(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, DIR)
    rel = db.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    got = sorted(tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_excerpts_of_every_hit(spark, tmp_path):
    """With body names spelt otherwise the excerpts are the same, and hits without a body keep their places."""
    from pyspark.sql import functions as F

    from corpusloom.functions.names import plain_name

    want = {r.doc_id: r for r in QUERIES["r01_excerpts"](spark, DIR).collect()}
    for p in glob.glob(f"{DIR}/*.parquet"):
        if os.path.basename(p) != "urlinfo.parquet":
            os.symlink(p, tmp_path / os.path.basename(p))
    body = plain_name(F.col("sname")) == "body"
    spark.read.parquet(f"{DIR}/urlinfo.parquet").withColumn("sname", F.when(body, F.lit(" BODY")).otherwise(F.col("sname"))).write.parquet(f"{tmp_path}/urlinfo.parquet")
    got = {r.doc_id: r for r in QUERIES["r01_excerpts"](spark, str(tmp_path)).collect()}
    assert got == want and sorted(r.place for r in got.values()) == list(range(1, len(got) + 1)) and got
