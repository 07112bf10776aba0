"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders made and not yet removed by this process.
_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where it is unset a temporary folder
    takes its place and goes when the process ends; that only serves a local
    master, so anywhere else an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        local = tempfile.mkdtemp(prefix="hinflow-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
    _MADE.append(f"{base.rstrip('/')}/hinflow/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


#: Spark's switch for deleting a query's shuffle files as soon as the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows starts from replicated files, whichever
    executors are lost meanwhile, and Catalyst knows the table's real size.
    The shuffle files of the write go when it ends, not when the driver next
    collects garbage; a lost executor during the write is repaired as usual.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whichever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _MADE:
        _MADE.remove(path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end, the scratch folders made within: consume a query's result inside.

    ``with cleared(spark): query(...).write.parquet(...)``
    """
    before = set(_MADE)
    try:
        yield
    finally:
        for path in [p for p in _MADE if p not in before]:
            remove(spark, path)


def discard(df: DataFrame) -> None:
    """Delete what ``written`` wrote for ``df``; nothing may read it afterwards."""
    remove(df.sparkSession, df.scratch_path)
