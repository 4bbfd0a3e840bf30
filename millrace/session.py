"""Spark session for tests and the bench; on a cluster, use the cluster's own."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors, as ``--py-files`` does; once for an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent
    archive = f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}"
    context.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))


def local_session(cores: int = 8, app_name: str = "millrace") -> SparkSession:
    """A ``local[cores]`` session with one shuffle partition per core."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark
