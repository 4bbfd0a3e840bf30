"""Texts alike in their shingles, found by prefix filters, which miss no pair.

Shingles are put in one order for all texts, those in rare buckets of hashes first. Two
sets of ``n`` and ``m`` shingles with a Jaccard similarity of ``s`` or more share one of
the first ``n - ceil(s * n) + 1`` of the one and the first ``m - ceil(s * m) + 1`` of the
other, whatever the order. The first that they share leaves at most as many in common as
follow it in either set, which rules out most pairs unseen; the others are verified on
the sets.

Of a key that very many sets share, only pairs with one of them, its middle, are made.
Sets of that star are then told apart by how they differ from the middle. Alike sets
differ in at most ``c * (n + m)`` shingles, ``c = (1 - s) / (1 + s)``. If two sets differ
from the middle in no more than that together, both are alike to it and are linked
already; if in ``d`` and ``e``, they have ``(d + e - c * (n + m)) / 2`` of these differences in
common, or more. So a second prefix filter, over differences instead of shingles, finds
all other pairs of a star.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._arrow import pieces
from millrace.llm._scratch import dropped, written
from millrace.llm.components import components

# A key of more sets is a star: pairs with its middle, then by what differs from that.
CROWDED = 64
# Sets of a star, about so many, that tell which differences are frequent in it.
SAMPLED = 256
# Of shingle hashes; how full they are decides the order only.
BUCKETS = 1 << 20
_U = np.uint64


def _shingles(text: bytes | None, width: int) -> list[bytes]:
    words = (text or b"").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [joined[a:b] for a, b in zip(starts, ends[width - 1 :] or ends[-1:])]


def _hashes(text: bytes | None, width: int) -> np.ndarray:
    from xxhash import xxh64_digest

    digests = b"".join([xxh64_digest(s, 42) for s in _shingles(text, width)])
    return np.unique(np.frombuffer(digests, ">u8").astype(_U))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & _U(BUCKETS - 1)).astype(np.intp)


def _bucket_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many shingles of all texts are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in pieces(batches):
            texts_ = batch.column("text").cast(pa.binary()).to_pylist()
            found = [_hashes(t, width) for t in texts_]
            total += np.bincount(_bucket(np.concatenate(found)), minlength=BUCKETS)
        at = np.flatnonzero(total)
        columns = [pa.array(at, pa.int32()), pa.array(total[at], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "n"])

    each = texts.select("text").mapInArrow(run, "bucket int, n long")
    found = each.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def _prefixes(texts: DataFrame, width: int, similarity: float, counts: Broadcast) -> DataFrame:
    """``number``, ``id1`` and ``id2`` (hash of the set of shingles), its size ``n`` and ``keys``: the
    shingles of its prefix in order. Texts without words have none and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        full = counts.value
        for batch in pieces(batches):
            numbers, digests, sizes, keys = [], [], [], []
            texts_ = batch.column("text").cast(pa.binary()).to_pylist()
            for number, text in zip(batch.column("number").to_pylist(), texts_, strict=True):
                found = _hashes(text, width)
                if not len(found):
                    continue
                n = len(found)
                first = min(n - ceil(similarity * n - 1e-6) + 1, n)
                order = np.lexsort((found, full[_bucket(found)]))[:first]
                numbers.append(number)
                digests.append(xxh3_128_digest(found.tobytes()))
                sizes.append(n)
                keys.append(found[order].view(np.int64))
            ids = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            columns = (numbers, ids[:, 0], ids[:, 1], sizes, keys)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["number", "id1", "id2", "n", "keys"],
            )

    found = "number long, id1 long, id2 long, n int, keys array<long>"
    return texts.select("number", "text").mapInArrow(run, found)


def _may(similarity: float) -> Column:
    """Whether ``x`` and ``y`` can be alike if the shingle they share is their first."""
    left = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
    return left >= (F.col("x.n") + F.col("y.n")) * F.lit(similarity / (1 + similarity)) - 1e-6


def _ends(pairs: DataFrame) -> DataFrame:
    a, b = F.col("x.id"), F.col("y.id")
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _entries(marked: DataFrame) -> DataFrame:
    """``key``, ``id``, ``n``, ``i`` (place of the key in order) and ``shared``: how many sets have
    the key in their prefix, two at least."""
    each = marked.where("number = id").select("id", "n", F.posexplode("keys").alias("i", "key"))
    sizes = each.groupBy("key").agg(F.count(F.lit(1)).alias("shared")).where("shared > 1")
    return written(each.join(sizes, "key"), "prefixes")


def _stars(entries: DataFrame) -> DataFrame:
    """Crowded keys with their sets: ``id``, ``n``, ``i``, and ``middle``, ``middle_n``, ``middle_i`` of the set
    that has the most crowded keys for its size, since what copies of one text changed is
    rare and fills their prefixes, and a long text is no middle of short ones."""
    many = entries.where(F.col("shared") > CROWDED)
    # 40 more, so that a text of a shingle or two is none either.
    rank = F.count(F.lit(1)) / (F.first("n") + 40)
    ranks = many.groupBy("id").agg(rank.alias("rank"))
    middle = many.join(ranks, "id").groupBy("key")
    middle = middle.agg(F.max_by(F.struct("id", "n", "i"), F.struct("rank", "id")).alias("m"))
    middle = middle.select("key", F.col("m.id").alias("middle"), F.col("m.n").alias("middle_n"), F.col("m.i").alias("middle_i"))
    return written(many.join(middle, "key").where("id <> middle"), "stars")


def _first_pairs(entries: DataFrame, stars: DataFrame, similarity: float) -> DataFrame:
    """All pairs ``a`` < ``b`` of a key that is not crowded, and those of a star with its middle."""
    few = entries.where(F.col("shared") <= CROWDED)
    pairs = few.alias("x").join(few.alias("y"), "key")
    pairs = pairs.where(_may(similarity) & (F.col("x.id") < F.col("y.id")))
    spokes = stars.select(
        F.struct("id", "n", "i").alias("x"),
        F.struct(F.col("middle").alias("id"), F.col("middle_n").alias("n"), F.col("middle_i").alias("i")).alias("y"),
    )
    return _ends(pairs).union(_ends(spokes.where(_may(similarity)))).distinct()


def _apart(sets: pa.Array, middles: pa.Array) -> Iterator[np.ndarray]:
    """The shingles that only one of set and middle has, for each pair."""
    for own, middle in zip(sets, middles, strict=True):
        yield np.setxor1d(own.values.to_numpy(), middle.values.to_numpy(), assume_unique=True)


def _frequent(stars: DataFrame) -> DataFrame:
    """``middle``, ``tokens`` and ``times``: in how many sets of a star, of some ``SAMPLED``, each shingle
    tells set and middle apart, if in two or more. It decides the order only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_apart(batch.column("s"), batch.column("m")))
            rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            tokens = np.concatenate(found) if found else np.zeros(0, np.int64)
            columns = [batch.column("middle").take(rows), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["middle", "token"])

    some = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * F.col("all") < F.lit(SAMPLED << 20)
    each = stars.where(some).select("middle", "s", "m").mapInArrow(run, "middle long, token long")
    each = each.groupBy("middle", "token").agg(F.count(F.lit(1)).cast("int").alias("times")).where("times > 1")
    lists = each.groupBy("middle").agg(F.collect_list(F.struct("token", "times")).alias("both"))
    return lists.select("middle", F.col("both.token").alias("tokens"), F.col("both.times").alias("times"))


def _differences(stars: DataFrame, similarity: float) -> DataFrame:
    """``middle``, ``id``, ``label``, ``stray``, ``n``, ``d`` (how many shingles are in one of set and middle only),
    ``token`` (one of those) and ``i``, its place in order, the least frequent first.

    Only so many come out as can be the first that is common with a set that is alike.
    """
    c = (1 - similarity) / (1 + similarity)
    names = ["middle", "id", "label", "stray", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, tokens, places = [], [], [], []
            often = zip(batch.column("tokens"), batch.column("times"), strict=True)
            apart = _apart(batch.column("s"), batch.column("m"))
            for k, (found, (known, times)) in enumerate(zip(apart, often, strict=True)):
                n = np.zeros(len(found), np.int64)
                if known.is_valid and len(known):
                    known, times = known.values.to_numpy(), times.values.to_numpy()
                    order = np.argsort(known)
                    at = order[np.minimum(np.searchsorted(known, found, sorter=order), len(known) - 1)]
                    n = np.where(known[at] == found, times[at], 0)
                size = batch.column("n")[k].as_py()
                most = int(c * size * (1 + 1 / similarity) + 1e-6) + 1
                order = np.lexsort((found, n))[:most]
                rows.append(np.full(len(order), k))
                sizes.append(np.full(len(order), len(found), np.int32))
                tokens.append(found[order])
                places.append(np.arange(len(order), dtype=np.int32))
            rows = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            made = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (sizes, tokens, places)]
            types = (pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name).take(rows) for name in names),
                    *(pa.array(v, t) for v, t in zip(made, types, strict=True)),
                ],
                [*names, "d", "token", "i"],
            )

    made = "middle long, id long, label long, stray boolean, n int, d int, token long, i int"
    return stars.mapInArrow(run, made)


def _other_pairs(
    stars: DataFrame, sets: DataFrame, links: DataFrame, similarity: float
) -> DataFrame:
    """Pairs of a star that ``links`` do not connect yet and that differ from its middle alike."""
    found = components(links).toDF("id", "label")
    own = stars.select("middle", "id", "n").distinct().join(found, "id", "left")
    own = own.withColumn("label", F.coalesce("label", "id"))
    # A star is done with if all of it is in one component; else one of each pair is a stray.
    sizes = own.groupBy("middle", "label").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("middle").agg(
        F.max_by("label", F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("size").alias("all")
    )
    own = own.join(main.where("labels > 1").drop("labels"), "middle")
    own = own.withColumn("stray", F.col("label") != F.col("main")).drop("main")
    own = own.join(sets.toDF("id", "s"), "id").join(sets.toDF("middle", "m"), "middle")
    own = written(own, "mixed-stars")
    own = own.join(_frequent(own), "middle", "left")
    tokens = written(_differences(own, similarity), "differences")
    x, y = tokens.alias("x"), tokens.alias("y")
    c = F.lit((1 - similarity) / (1 + similarity))
    need = (F.col("x.d") + F.col("y.d") - c * (F.col("x.n") + F.col("y.n"))) / 2 - 1e-6
    left = F.least(F.col("x.d") - F.col("x.i"), F.col("y.d") - F.col("y.i"))
    once = ~F.col("y.stray") | (F.col("x.id") < F.col("y.id"))
    sizes = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(similarity) - 1e-6
    # The set that differs less needs only the first half of its prefix.
    half = [F.col(f"{v}.i") <= c * F.col(f"{v}.n") * (1 + 1 / similarity) / 2 + 1e-6 for v in ("x", "y")]
    short = F.when(F.col("x.d") < F.col("y.d"), half[0]).otherwise(half[1])
    same = (F.col("x.middle") == F.col("y.middle")) & (F.col("x.token") == F.col("y.token"))
    apart = F.col("x.label") != F.col("y.label")
    pairs = x.where("stray").join(y, same & apart & once & sizes & short & (left >= need))
    return _ends(pairs).distinct()


def _sets(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts_ = batch.column("text").cast(pa.binary()).to_pylist()
            found = [_hashes(t, width).view(np.int64) for t in texts_]
            columns = [batch.column("number"), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "s"])

    return texts.select("number", "text").mapInArrow(run, "id long, s array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` whose sets are alike."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    alike = both.where(shared >= union * F.lit(similarity) - 1e-9)
    return written(alike.select("a", "b"), "links")


def _identity(text: str) -> list[Column]:
    """Two differently seeded hashes of a text, 128 bits together."""
    content = F.coalesce(text, F.lit(""))
    return [F.xxhash64(content).alias("one"), F.xxhash64(F.lit(1), content).alias("two")]


def groups(
    docs: DataFrame,
    similarity: float = 0.8,
    width: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    also: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``one`` and ``two`` (hashes of a text), and ``least_id``, ``least_one``, ``least_two``: of the texts in
    its group, the one with the smallest ``doc_id`` (null last), then the smallest hashes.

    Texts are linked if the Jaccard similarity of their sets of ``width``-word shingles,
    A-Z in lower case, is at least ``similarity`` (sets of 64-bit hashes), which is more
    than 0; a group is what links connect. A text of fewer words is one shingle. Texts
    without words are linked to equal ones only, where null counts as empty. No linked
    pair is missed, but for those that other links connect anyway. Texts and sets are told
    apart by 128 bits. An empty table gives no rows.

    ``also`` gives further links: two columns of ``number`` for the distinct texts, of which it
    gets ``number`` and ``text`` (null is empty). A group is what links of either kind connect.

    Of a key with more than ``CROWDED`` sets no pairs are made but with one of them, and
    those that differ from that one in enough of the same shingles.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), *_identity(text), F.coalesce(text, F.lit("")).alias("text"))
    texts = own.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.first("text").alias("text"))
    texts = written(texts.withColumn("number", F.monotonically_increasing_id()), "texts")
    given = written(also(texts.select("number", "text")).toDF("a", "b"), "given-links") if also else None
    counts = docs.sparkSession.sparkContext.broadcast(_bucket_counts(texts, width))
    marked = written(_prefixes(texts, width, similarity, counts), "marked")
    # Equal sets are one node, with the smallest number.
    nodes = marked.groupBy("id1", "id2").agg(F.min("number").alias("id"))
    marked = written(marked.join(nodes, ["id1", "id2"]).drop("id1", "id2"), "nodes")
    entries = _entries(marked)
    stars = _stars(entries)
    pairs = written(_first_pairs(entries, stars, similarity), "candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("number"))
    ends = ends.union(stars.select("id")).union(stars.select("middle")).distinct()
    sets = written(_sets(texts.join(ends, "number", "left_semi"), width), "shingle-sets")
    links = _verified(pairs, sets, similarity)
    # Texts of one node, since other links go by texts and not by nodes.
    links = links.union(marked.where("number <> id").select("number", "id"))
    if given is not None:
        links = links.union(given)
    if not stars.isEmpty():
        others = written(_other_pairs(stars, sets, links, similarity), "more-candidates")
        links = links.union(_verified(others, sets, similarity))

    found = components(links).toDF("number", "component")
    of = texts.select("number", "one", "two", "least").join(found, "number", "left")
    # A text that nothing links is a group of its own; one without words is in no set.
    of = of.withColumn("component", F.coalesce("component", "number"))
    rank = F.struct(F.col("least").isNull().alias("none"), "least", "one", "two")
    # As a table of its own, so that a component of very many texts is split like any skewed join.
    lowest = written(of.groupBy("component").agg(F.min(rank).alias("low")), "lowest")
    found = of.join(lowest, "component").select(
        "one",
        "two",
        F.col("low.least").alias("least_id"),
        F.col("low.one").alias("least_one"),
        F.col("low.two").alias("least_two"),
    )
    found = written(found, "near-groups")
    for table in (texts, marked, entries, stars, pairs, sets):
        dropped(table)
    return found


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each of the ``groups``: the one with the smallest id, null last.

    Of several texts with that id the one with the smallest hashes stays, and of rows equal
    in id and text one. Columns and their names are those of ``docs``.
    """
    found = groups(docs, doc_id=doc_id, text=text, **options)
    found = found.where("one = least_one AND two = least_two")
    found = found.select(F.col("least_id").alias("id"), "one", "two", F.xxhash64("least_id").alias("key"))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), *_identity(text), F.xxhash64(doc_id).alias("key"), F.col(doc_id).alias("own_id")
    )
    # Ids are part of the key, so that copies of one text do not meet in one task.
    kept = rows.join(found, ["key", "one", "two"]).where(F.col("own_id").eqNullSafe(F.col("id")))
    return kept.dropDuplicates(["key", "one", "two"]).select("row.*")
