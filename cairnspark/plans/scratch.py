"""Cutting lineage: tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_written: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, as in local tests, a folder of our own; on a cluster that is an error, as machines don't see each other's folders."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="cairnspark-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/cairnspark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def only(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """:func:`materialise` what ``build`` returns, and delete every table that was written on the way to it."""
    before = len(_written)
    kept = materialise(build())
    *passing, last = _written[before:]
    _written[before:] = [last]
    _delete(spark, passing)
    return kept


def passing(spark: SparkSession, build: Callable):
    """What ``build`` returns, which reads no table, and every table that was written on the way to it is deleted."""
    before = len(_written)
    value = build()
    paths = _written[before:]
    del _written[before:]
    _delete(spark, paths)
    return value


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it a query's shuffle files go when the query ends; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def release(spark: SparkSession) -> None:
    """Delete every table that :func:`materialise` wrote; frames built on them can't be read afterwards."""
    _delete(spark, _written)
    _written.clear()
