"""Near duplicates by SimHash and the generalised pigeonhole principle.

A fingerprint of 64 bits is cut into partitions of bits with a threshold each. If
the thresholds add up to ``max_distance - partitions + 1``, two fingerprints within
``max_distance`` differ in at most its threshold in one partition at least; -1
leaves a partition out. Which bits go together, how many partitions there are and
which thresholds they get is worked out from counts over all fingerprints; a probe
looks up the values within the threshold, and each hit is verified.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._arrow import appended, pieces
from millrace.llm._scratch import written
from millrace.llm.components import components

BITS = 64
SEED = 42
# Values shared by more fingerprints than this are linked by way of midpoints.
CROWDED = 64
_BLOCK = 1 << 16


def fingerprint(text: bytes, width: int) -> int:
    """SimHash over the ``width``-word shingles of a text, A-Z in lower case."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[width - 1 :] or ends[-1:]
    ones, n = np.zeros(BITS, np.int64), len(last)
    for at in range(0, n, _BLOCK):
        spans = zip(starts[at : at + _BLOCK], last[at : at + _BLOCK])
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in spans])
        rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with a long column ``fp``; no words: zero."""
    rest = [f for f in docs.schema.fields if f.name != text]
    if "fp" in {f.name for f in rest}:
        raise ValueError("column fp exists already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t or b"", width) for t in texts], np.uint64)
            yield appended(batch.drop_columns([text]), fp=pa.array(found.view(np.int64)))

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField("fp", T.LongType())]))


def shared_ones(fps: DataFrame) -> np.ndarray:
    """How often each pair of bits is set together; on the diagonal, each bit alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).astype(">i8")
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += bits.T @ bits
        n = pa.array(total.ravel().astype(np.int64))
        cell = pa.array(np.arange(BITS * BITS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([cell, n], ["cell", "n"])

    cells = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n"))
    counts = np.zeros(BITS * BITS)
    for cell, n in cells.collect():  # one row for each pair of bits
        counts[cell] = n
    return counts.reshape(BITS, BITS)


def correlated_groups(ones: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The bits in ``m`` groups of even size, each grown from a bit by adding the most correlated."""
    p = np.diag(ones) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(ones / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        left = sorted(free)
        seed = max(left, key=lambda b: (related[b, left].sum(), -b))
        group = [seed]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(max(rest, key=lambda b: (related[b, group].sum(), -b)))
        groups.append(sorted(group))
        free -= set(group)
    return groups


def mask(bits: Sequence[int]) -> int:
    """A signed long with these bits set, bit 0 the most significant."""
    value = sum(1 << (BITS - 1 - b) for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 on that add up to ``total`` at the least cost; ``cost[i][t + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (price, chosen) in best.items():
            for t, extra in enumerate(row, -1):
                offer = (price + extra, [*chosen, t])
                if spent + t not in after or offer < after[spent + t]:
                    after[spent + t] = offer
        best = after
    return best.get(total, (float("inf"), []))


def plan(nodes: DataFrame, max_distance: int) -> list[Part]:
    """Partitions and thresholds of the least estimated work, from counts over all of ``nodes``.

    For each number of partitions, the pairs that agree in each group of bits are
    counted; for larger thresholds that count is scaled by the odds of a bit to
    differ. Work is probes plus candidates.
    """
    n = nodes.count()
    ones = shared_ones(nodes)
    p = np.diag(ones) / max(n, 1)
    differ = 2 * p * (1 - p)
    odds = differ / np.maximum(1 - differ, 1e-9)
    layouts = [correlated_groups(ones, n, m) for m in range(1, max_distance + 3)]
    flat = [group for groups in layouts for group in groups]
    equal = _values(nodes, flat).groupBy("part", "value").count().groupBy("part")
    pairs = dict(equal.agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1))).collect())
    best: tuple[float, list[Part]] = (float("inf"), [])
    at = 0
    for groups in layouts:
        cost = []
        for k, group in enumerate(groups):
            row, probes, scale, sums = [0.0], 0, 0.0, np.array([1.0])
            for b in group:
                sums = np.convolve(sums, [1.0, odds[b]])[: max_distance + 1]
            for t in range(max_distance + 1):
                probes += comb(len(group), t)
                scale += sums[t] if t < len(sums) else 0
                row.append(n * probes + pairs.get(at + k, 0.0) * scale)
            cost.append(row)
        at += len(groups)
        price, chosen = allocate(cost, max_distance - len(groups) + 1)
        parts = [Part(tuple(g), t) for g, t in zip(groups, chosen) if t >= 0]
        if price < best[0]:
            best = (price, parts)
    return best[1]


def _values(nodes: DataFrame, groups: Sequence[Sequence[int]]) -> DataFrame:
    """``part``, ``value`` (the part's bits) and ``fp``, a row for each of the groups."""
    entries = [
        F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(mask(g))).alias("value"))
        for k, g in enumerate(groups)
    ]
    return nodes.select("fp", F.inline(F.array(*entries))).select("part", "value", "fp")


def _flips(bits: Sequence[int], most: int) -> list[int]:
    return [mask(c) for r in range(most + 1) for c in combinations(bits, r)]


def _flipped(value: Column, bits: Sequence[int], most: int) -> Column:
    flips = F.lit(_flips(bits, most)).cast("array<bigint>")
    return F.explode(F.transform(flips, lambda x: value.bitwiseXOR(x)))


def links(nodes: DataFrame, max_distance: int = 2) -> DataFrame:
    """Pairs ``a``, ``b`` of fingerprints that link all within ``max_distance`` of each other.

    ``nodes`` has distinct fingerprints ``fp``. Pairs that meet in a value of at
    most ``CROWDED`` fingerprints are given as they are. Fingerprints that probe a
    more crowded value are linked by way of midpoints instead: two of them are
    within ``max_distance`` exactly if some value is within half of that of both,
    so all around one value are linked to the smallest of them, and no value gives
    more rows than it has fingerprints. Either way no link between components is
    lost. ``max_distance`` must be even, so that halves meet.
    """
    if max_distance < 0 or max_distance % 2:
        raise ValueError("max_distance must be even")
    parts = plan(nodes, max_distance)
    index = _values(nodes, [p.bits for p in parts])
    probe = None
    for k, part in enumerate(parts):
        own = index.where(F.col("part") == k)
        if part.threshold:
            own = own.select("part", _flipped(F.col("value"), part.bits, part.threshold).alias("value"), "fp")
        probe = own if probe is None else probe.union(own)
    sizes = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("size"))
    flips = F.lit([p.threshold for p in parts])[F.col("part")]
    few = sizes.where((F.col("size") <= CROWDED) & ((F.col("size") > 1) | (flips > 0)))
    quiet = index.join(few, ["part", "value"]).select("part", "value", F.col("fp").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= max_distance
    pairs = probe.join(quiet, ["part", "value"]).where(near & (F.col("fp") < F.col("b")))

    many = sizes.where(F.col("size") > CROWDED)
    crowd = probe.join(many, ["part", "value"], "left_semi").select("fp").distinct()
    around = crowd.select(
        "fp", _flipped(F.col("fp"), range(BITS), max_distance // 2).alias("middle")
    )
    least = around.groupBy("middle").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("size"))
    least = least.where(F.col("size") > 1).drop("size")
    stars = around.join(least, "middle").where(F.col("fp") != F.col("b"))
    return pairs.select(F.col("fp").alias("a"), "b").union(stars.select("fp", "b")).distinct()


def near_duplicates(
    docs: DataFrame,
    width: int = 3,
    max_distance: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every document.

    Documents are linked if their fingerprints differ in at most ``max_distance``
    bits; ``component_id`` is the smallest ``doc_id`` that can be reached, itself
    included. A null or wordless text has fingerprint zero and is linked like any
    other. A null ``doc_id`` never is the smallest; where all are null, so is
    ``component_id``. Repeated rows each get a row; ties link at distance zero.
    An empty table gives no rows; other columns are ignored.

    Equal fingerprints are aggregated first, so a group of copies is one node.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = written(fingerprints(rows, width), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = written(nodes, "distinct-fingerprints")
    found = components(links(nodes, max_distance)).withColumnRenamed("node", "fp")
    linked = nodes.join(found, "fp")
    lowest = linked.groupBy("component").agg(F.min("least").alias("lowest"))
    linked = found.join(lowest, "component").select("fp", "lowest")
    labels = nodes.join(linked, "fp", "left").select(
        "fp", F.coalesce("lowest", "least").alias("component_id")
    )
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))
