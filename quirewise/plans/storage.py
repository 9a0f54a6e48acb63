"""Shared storage for intermediate tables."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="quirewise-")


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Where that is unset, a session inside one process gets a temporary folder and
    any other a folder in the warehouse, which all of its executors share.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext._jsc.sc().isLocal():
        return _local_dir()
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    Cuts the lineage (a lost executor re-reads files, not the whole plan), and
    readers get column pruning and real table sizes for their joins.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes in here leave no shuffle files behind, which otherwise stay until the driver collects its garbage.

    A write that has ended never reads them again; tasks and stages that fail before
    its end find them.
    """
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)
