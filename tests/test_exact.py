from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import exact_sum

# Whole cents, turned into the nearest double as a table would hold them.
CENTS = st.integers(min_value=-(10**15), max_value=10**15)




def total(spark, amounts, partitions=1, scale=2):
    rows = spark.createDataFrame([(a,) for a in amounts], "amount double")
    return rows.repartition(partitions).agg(exact_sum(F.col("amount"), "amount", scale)).first()[0]


@settings(
    max_examples=25,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(cents=st.lists(CENTS, min_size=1, max_size=40), partitions=st.integers(1, 4))
def test_equals_integer_arithmetic(spark, cents, partitions):
    assert total(spark, [c / 100 for c in cents], partitions) == Decimal(sum(cents)).scaleb(-2)


def test_does_not_lose_small_amounts(spark):
    # In doubles the ten cents vanish beside the large amount.
    assert total(spark, [8e13, 0.1, -8e13]) == Decimal("0.10")


def test_result_is_the_same_for_any_split(spark):
    rows = spark.range(100_000).select((F.col("id") * 7919 % 1_000_003 / 100).alias("amount"))
    totals = {
        rows.repartition(n).agg(exact_sum(F.col("amount"), "amount")).first()[0] for n in (1, 3, 8, 13)
    }
    assert totals == {Decimal(sum(i * 7919 % 1_000_003 for i in range(100_000))).scaleb(-2)}


def test_sums_past_one_bigint_of_cents(spark):
    # 2 * 10**20 cents: more than a bigint holds.
    rows = spark.range(200_000, numPartitions=8).select(F.lit(1e13).alias("amount"))
    assert rows.agg(exact_sum(F.col("amount"), "amount")).first()[0] == Decimal("2E+18")


def test_skips_nulls_and_is_null_when_empty(spark):
    assert total(spark, [1.25, None, 2.5]) == Decimal("3.75")
    assert total(spark, [None]) is None
    assert total(spark, []) is None


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.unset("spark.sql.ansi.enabled")


@pytest.mark.parametrize(
    "amount", [float("nan"), float("inf"), float("-inf"), 1e14, 0.004, 0.125, -0.005]
)
def test_raises_on_amounts_not_in_whole_cents(spark, ansi, amount):
    with pytest.raises(Exception, match="amount: an amount is NaN, infinite, too large or has over 2"):
        total(spark, [1.0, amount])


def test_more_places_are_exact_where_declared(spark, ansi):
    assert total(spark, [0.004] * 1000, scale=3) == Decimal("4.000")
    assert total(spark, [0.125, 0.125, -0.005], scale=3) == Decimal("0.245")
    assert total(spark, [0.00001, 2.0], scale=5) == Decimal("2.00001")
    assert total(spark, [3.0, -5.0], scale=0) == Decimal("-2")


def test_scale_has_bounds():
    for scale in (-1, 6):
        with pytest.raises(ValueError, match="scale"):
            exact_sum(F.col("amount"), "amount", scale)


def test_cannot_overflow(spark, ansi):
    # Just below the limit for one amount, and far beyond a bigint in sum.
    rows = spark.range(80_000_000, numPartitions=8).select(F.lit(8e13).alias("amount"))
    assert rows.agg(exact_sum(F.col("amount"), "amount")).first()[0] == Decimal("6400000000000000000000.00")
