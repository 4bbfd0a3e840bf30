"""Shipped-line summary: what was shipped up to a day, by flag and status."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import group_totals
from millrace.sources import read_table

SHIPPED_BY = date(1998, 9, 2)

ORACLE_SQL = f"""
SELECT l_returnflag,
       l_linestatus,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS sum_base_price,
       COUNT(*) AS count_order
FROM lineitem
WHERE l_shipdate < DATE '{SHIPPED_BY + timedelta(days=1)}'
GROUP BY l_returnflag, l_linestatus
"""


def summarize_shipped_lines(lineitem: DataFrame, shipped_by: date = SHIPPED_BY) -> DataFrame:
    """Totals of the lines shipped on or before the day ``shipped_by``."""
    # A bound on the bare column, so that the filter reaches the parquet scan.
    shipped = lineitem.filter(F.col("l_shipdate") < F.lit(shipped_by + timedelta(days=1)))
    return group_totals(
        shipped,
        keys=["l_returnflag", "l_linestatus"],
        amounts={"sum_qty": "l_quantity", "sum_base_price": "l_extendedprice"},
        count="count_order",
    )


def shipped_line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize_shipped_lines(read_table(spark, sf_dir, "lineitem"))
