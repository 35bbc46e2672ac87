"""The folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; else a temporary folder in local mode, the warehouse on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        folder = f"file://{tempfile.mkdtemp(prefix='rationale-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/rationale-scratch"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, kind: str = "table") -> str:
    return f"{scratch_folder(spark)}/rationale-{kind}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files: they would stay until the driver's garbage collection meets their frames."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors. Its shuffle files are deleted once it is written."""
    path = scratch_path(df.sparkSession)
    with _shuffles_deleted(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = path_of(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the tables that this program has stored so far, and say how many.

    To be called when the results that were made of them have been written or
    read: results are lazy and read these tables.
    """
    paths = _written[:]
    _written.clear()
    return _delete(spark, paths)


class ScratchScope:
    """The tables stored within a ``with`` block, to be deleted by ``clear`` when their results have been written."""

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> ScratchScope:
        self._before = len(_written)
        return self

    def __exit__(self, *_) -> None:
        self.paths += _written[self._before :]
        del _written[self._before :]

    def clear(self, spark: SparkSession) -> int:
        """Delete the tables, and let Spark find the shuffle files and broadcasts of frames that are no longer used.

        Spark removes those when the driver's garbage collection meets them, as
        its own periodic collection does every half hour.
        """
        paths, self.paths = self.paths, []
        if paths:
            gc.collect()
            spark.sparkContext._jvm.System.gc()
        return _delete(spark, paths)
