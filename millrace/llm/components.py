"""Connected components of a graph of longs, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._scratch import dropped, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of an edge.

    ``edges`` has two long columns; direction, repeats and loops don't matter,
    and an edge with a null end is left out. Each round links every node's larger
    neighbours to the smallest one, then its smaller ones; the number of rounds
    grows with the logarithm of a component's size, not its diameter. Minima are
    aggregated before the shuffle and joined back, so a node with very many
    neighbours is split like any skewed join; each round is a table in the shared
    folder, and nothing but its row count and checksum comes to the driver.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    now = written(
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        # Larger neighbours go to the smallest of u and its neighbours.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        then, before = written(small, "edges"), state
        dropped(now)
        now, state = then, _state(then)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
