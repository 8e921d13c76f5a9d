"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[list | None] = ContextVar("cache_scope", default=None)


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: the session's ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; a cluster without the setting is an error, since
    executors could not read a machine-local folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="embgauge-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in one folder per value of ``by``; ``discard`` deletes it."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    spark = table.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def keep(df: DataFrame) -> DataFrame:
    """Cache a table that is read more than once; a surrounding ``cache_scope`` drops it."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    scope = _scope.get()
    if scope is not None:
        scope.append(kept)
    return kept


@contextmanager
def cache_scope():
    """Everything kept inside is released at the end, so a long sweep holds one step's tables."""
    outer = _scope.set([])
    try:
        yield
    finally:
        for df in _scope.get():
            df.unpersist()
        _scope.reset(outer)


def fetched(df: DataFrame) -> DataFrame:
    """A result of a few rows, computed now; it no longer depends on cached tables."""
    rows = df.collect()
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], df.schema)
