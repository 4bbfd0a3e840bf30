from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``directory``.

    ``directory`` may be any path or URI Spark can read, and the table one file
    or a folder of files. Column pruning and filters are left to Catalyst.
    """
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
