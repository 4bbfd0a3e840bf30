import re
from collections import Counter
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.plans.shipped_lines import ORACLE_SQL, shipped_line_summary, summarize_shipped_lines

COLUMNS = (
    "l_returnflag string, l_linestatus string, l_quantity double, "
    "l_extendedprice double, l_shipdate timestamp_ntz"
)


def executed_plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def lineitem_path(spark, tmp_path):
    """900,000 lines in 8 files; one group holds a third of them."""
    path = str(tmp_path / "lineitem.parquet")
    i = F.col("id")
    (
        spark.range(900_000, numPartitions=8)
        .select(
            F.when(i % 3 == 0, "hot").otherwise((i % 7).cast("string")).alias("l_returnflag"),
            F.lit("O").alias("l_linestatus"),
            F.lit(1.0).alias("l_quantity"),
            F.lit(0.1).alias("l_extendedprice"),
            F.lit("1998-01-01").cast("timestamp_ntz").alias("l_shipdate"),
            F.lit("unread").alias("l_comment"),
        )
        .write.parquet(path)
    )
    return path


def test_takes_the_whole_last_day_and_drops_unknown_dates(spark):
    lines = spark.createDataFrame(
        [
            ("A", "F", 1.0, 0.1, datetime(1998, 9, 2)),
            ("A", "F", 2.0, 0.2, datetime(1998, 9, 2, 23, 59, 59)),
            ("A", "F", 4.0, 0.4, datetime(1998, 9, 3)),
            ("A", "F", 8.0, 0.8, None),
            ("A", "O", None, 1.5, datetime(1998, 1, 1)),
            (None, "O", 3.0, None, datetime(1998, 1, 1)),
        ],
        COLUMNS,
    )
    rows = {tuple(r) for r in summarize_shipped_lines(lines, date(1998, 9, 2)).collect()}
    assert rows == {
        ("A", "F", 3.0, 0.3, 2),
        ("A", "O", None, 1.5, 1),
        (None, "O", 3.0, None, 1),
    }


def test_no_lines_give_no_groups(spark):
    assert summarize_shipped_lines(spark.createDataFrame([], COLUMNS)).count() == 0


def test_cut_off_is_a_parameter(spark):
    lines = spark.createDataFrame(
        [("A", "F", 1.0, 1.0, datetime(1998, 1, d)) for d in (1, 2, 3)], COLUMNS
    )
    counts = [
        [r.count_order for r in summarize_shipped_lines(lines, date(1998, 1, d)).collect()]
        for d in (1, 2, 3)
    ]
    assert counts == [[1], [2], [3]]


def test_scan_is_pruned_and_filtered(spark, lineitem_path):
    plan = executed_plan(summarize_shipped_lines(spark.read.parquet(lineitem_path)))
    assert "LessThan(l_shipdate,1998-09-03T00:00)" in plan
    schema = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert {field.split(":")[0] for field in schema.split(",")} == {
        "l_returnflag",
        "l_linestatus",
        "l_quantity",
        "l_extendedprice",
        "l_shipdate",
    }


def test_one_shuffle_after_a_partial_aggregation(spark):
    plan = executed_plan(shipped_line_summary(spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange") == 1
    before, after = plan.split("Exchange")
    assert "partial_sum" in after and "partial_sum" not in before
    assert "Python" not in plan and "SortAggregate" not in plan


def test_hot_group_sends_one_row_per_task(spark, lineitem_path, capsys):
    lines = spark.read.parquet(lineitem_path)
    summary = summarize_shipped_lines(lines)
    rows = {r.l_returnflag: r for r in summary.collect()}
    assert rows["hot"].count_order == 300_000
    assert rows["hot"].sum_base_price == 30_000.0
    assert sum(r.count_order for r in rows.values()) == 900_000

    summary.explain("formatted")
    stage = re.search(r"ShuffleQueryStage.*rowCount=(\d+)\)", capsys.readouterr().out)
    shuffled = int(stage.group(1))
    assert shuffled <= len(rows) * lines.rdd.getNumPartitions()


def test_large_amounts_and_null_keys_equal_the_oracle(spark, tmp_path):
    rows = [
        ("A", None, 1.0, 2e13, datetime(1998, 9, 2)),
        ("A", None, 2.5, 9e13, datetime(1998, 1, 1)),
        (None, "F", 3.0, -0.01, datetime(1998, 9, 3)),
        (None, "F", 3.0, 0.01, datetime(1998, 9, 2, 23)),
    ]
    path = tmp_path / "lineitem.parquet"
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}/*.parquet')")
        expected = Counter(con.execute(ORACLE_SQL).fetchall())
    assert Counter(map(tuple, shipped_line_summary(spark, str(tmp_path)).collect())) == expected
    assert ("A", None, 3.5, 1.1e14, 2) in expected
