from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import exact_sum


def group_totals(
    rows: DataFrame,
    keys: Sequence[str],
    amounts: Mapping[str, str],
    count: str,
    scale: int = 2,
) -> DataFrame:
    """Exact totals and a row count for each group of ``keys``.

    ``amounts`` maps an output column to the double column it totals; ``count``
    names the row count. Amounts must have at most ``scale`` decimal places, be
    finite and lie below 2**53 units of the last place; one that does not fails
    the job with an error that names its column. Totals are exact and rounded
    once, at the end, to double like their inputs.

    One shuffle. Each map task sends at most one row per group, so a group that
    holds most of the rows is no hot spot.
    """
    totals = [
        exact_sum(F.col(source), source, scale).cast("double").alias(name)
        for name, source in amounts.items()
    ]
    return rows.groupBy(*keys).agg(*totals, F.count(F.lit(1)).alias(count))
