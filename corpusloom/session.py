"""Session helpers: shared scratch tables, package shipping and checked broadcasts."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side table may be broadcast by broadcast_if_small.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where it is unset (tests, local)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.corpusloom.scratch", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.corpusloom.scratch", conf)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf


_cleaned: set[str] = set()


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark).rstrip('/')}/corpusloom/{sc.applicationId}"
    if sc.applicationId not in _cleaned:
        _cleaned.add(sc.applicationId)
        jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
        atexit.register(_delete, jvm, conf, path)
    return path


def _delete(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone; then the folder stays
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that materialize wrote and that no plan reads any more. Of other tables nothing is deleted."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if f"/corpusloom/{spark.sparkContext.applicationId}/" in folder:
            _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder)


def drop_materialized(spark: SparkSession) -> None:
    """Delete every table written by materialize in this session."""
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), run_dir(spark))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def version_of(*tables: DataFrame) -> str:
    """A name for the present contents of the files the tables are read from: paths, sizes and times of change."""
    spark = tables[0].sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = hashlib.md5()
    for f in sorted({f for t in tables for f in t.inputFiles()}):
        p = jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(conf).getFileStatus(p)
        out.update(f"{f} {s.getLen()} {s.getModificationTime()}\n".encode())
    return out.hexdigest()


def stored(spark: SparkSession, name: str, inputs: list[DataFrame], write) -> str:
    """The path of a table derived from inputs, in the shared folder: written by write(path) once for each version of the inputs, then found again, in other sessions too."""
    path = f"{shared_dir(spark).rstrip('/')}/corpusloom/{name}-{version_of(*inputs)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        write(path)
    return path


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes; else as it is (then it is joined by shuffle).

    The rows are counted up to the bound only. Strings are measured, so a few very long ones do not pass.
    """
    text = [F.length(F.col(f"`{c}`")) for c, t in df.dtypes if t == "string"]
    weight = sum((F.coalesce(x, F.lit(0)) for x in text), F.lit(8 * len(df.columns)))
    n, b = df.select(weight.alias("w")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and 4 * b <= size else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: they need not have it on their path, in local mode neither."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, Path(root.name) / p.relative_to(root))
    target = os.path.join(tempfile.mkdtemp(prefix="corpusloom-code-"), "corpusloom.zip")
    Path(target).write_bytes(data.getvalue())
    sc.addPyFile(target)  # served to the executors by the driver
    _shipped.add(sc.applicationId)
