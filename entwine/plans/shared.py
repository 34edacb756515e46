"""Tables written into the folder that driver and executors share, to cut the lineage of iterative plans."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode without it, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="entwine_shared_")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """At most BATCH_ROWS rows go to Python at once while a table is written: rows may hold long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/entwine/{tag}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_staged(df: DataFrame) -> None:
    """Removes a table written by staged() that no later plan reads."""
    files = df.inputFiles()
    for spark, path in list(_written):
        if files and f"/{path.rsplit('/', 1)[1]}/" in files[0]:
            _delete(spark, path)
            _written.remove((spark, path))


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Removes at its end all tables staged inside: for drivers that live long. Write results before it ends."""
    before = len(_written)
    try:
        yield
    finally:
        for spark, path in _written[before:]:
            _delete(spark, path)
        del _written[before:]


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended first
            return


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application; they need not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(os.path.abspath(__file__)).parents[1]
    out = Path(tempfile.mkdtemp()) / "entwine_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)
