"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_TABLES: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; in local mode, one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def _frees_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, a finished query's shuffle files go at once, where Spark has that setting."""
    before = spark.conf.get(_CLEANUP, None)
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    with _frees_shuffles(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _delete(context: SparkContext, path: str) -> None:
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(frame: DataFrame) -> None:
    """Delete the files of a table from ``written`` that nothing reads any more."""
    for file in frame.inputFiles()[:1]:
        _delete(frame.sparkSession.sparkContext, file.rpartition("/")[0])


@atexit.register
def _clear() -> None:
    """Delete what is left when the program ends with its context still there."""
    context = SparkContext._active_spark_context
    for path in _TABLES if context is not None else ():
        with suppress(Exception):
            _delete(context, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
