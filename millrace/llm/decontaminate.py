"""Benchmark decontamination: short test items found inside long documents.

MinHash answers containment if only the small side is sketched. Of an item's ``n``
distinct shingles at least ``need = ceil(threshold * n)`` must occur in a document,
so at most ``n - need`` may be missing, and of its ``n - need + 1`` least hashes (its
bottom-k MinHash sketch) at least one occurs in every document that contains it.
``k`` follows from the item's size: items of equal size form a partition with one
sketch length and one least size of a document. Documents look up their shingles
in the sketches; each hit is a candidate, whose shared shingles are then counted
exactly. A document's length does not matter, unlike with a Jaccard threshold,
which for a 20-shingle item in a 20,000-shingle document would be 0.0008.

An item of fewer words than a shingle is one shingle of its own width, which documents are
asked for in a pass of their own, one for each such width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._scratch import written
from millrace.llm._words import LOWER, UPPER, shingle_hash, shingle_starts, shingle_text, words

# Up to so many hashes of sketches (some 30 bytes each), and so many shingles of items (some
# 100 bytes each), are sent to every executor.
BROADCAST_HASHES, BROADCAST_ROWS = 4_000_000, 500_000


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def item_shingles(
    items: DataFrame, width: int, threshold: float, item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """A row for each distinct shingle of an item: ``item``, ``item_id``, ``width`` (in words), ``hash``,
    ``shingle``, ``n_shingles``, ``need`` and ``in_sketch``."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    own = written(rows.withColumn("item", F.monotonically_increasing_id()), "items")
    own = own.select("item", "item_id", words(_lowered(F.col("text"))).alias("w"))
    own = own.withColumn("width", F.least(F.size("w"), F.lit(width)))
    spread = own.select("*", F.explode(shingle_starts(F.col("w"), width)).alias("at"))
    each = spread.select(
        "item",
        "item_id",
        "width",
        shingle_hash(F.col("w"), F.col("at"), width).alias("hash"),
        shingle_text(F.col("w"), F.col("at"), width).alias("shingle"),
    ).distinct()
    item = Window.partitionBy("item")
    rank = F.row_number().over(item.orderBy("hash", "shingle"))
    n = F.count(F.lit(1)).over(item)
    # Rounded, so that 0.8 * 5 does not become 5 by a last digit.
    need = F.ceil(F.round(n * F.lit(threshold), 9))
    return each.select(
        "*",
        n.alias("n_shingles"),
        need.alias("need"),
        (rank <= n - need + 1).alias("in_sketch"),
    )


def _shingles(docs: DataFrame, width: int, *columns: str, texts: bool) -> DataFrame:
    """``hash`` (and ``shingle``, if ``texts``) of each shingle of ``width`` words, with ``columns`` of its
    document. Words stay behind: no row takes more than its own shingle along."""
    w, at = F.col("w"), F.col("at")
    long = docs.where(F.size("w") >= width)
    spread = long.select(*columns, "w", F.explode(shingle_starts(w, width)).alias("at"))
    text = [shingle_text(w, at, width).alias("shingle")] if texts else []
    return spread.select(*columns, shingle_hash(w, at, width).alias("hash"), *text)


def _candidates(docs: DataFrame, sketch: DataFrame, width: int) -> DataFrame:
    """``doc`` and ``item`` wherever a shingle of a document has the hash of one in an item's sketch."""
    # A document of fewer shingles than an item needs cannot contain it.
    found = docs.withColumn("most", F.size("w") - width + 1)
    found = _shingles(found, width, "doc", "most", texts=False)
    hashes = sketch.select("hash").distinct()
    if hashes.count() <= BROADCAST_HASHES:
        # Shingles that no item has go no further.
        found = found.join(F.broadcast(hashes), "hash", "left_semi")
    found = found.distinct().join(sketch.select("hash", "item", "need"), "hash")
    return found.where("most >= need").select("doc", "item").distinct()


def find_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    width: int = 5,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """Each document and each item that it contains: ``doc`` (hashes of id and text), ``doc_id``,
    ``item_id``, ``n_shared``, ``n_shingles``.

    An item is contained if at least ``threshold`` of its distinct shingles of
    ``width`` words occur in the document, A-Z in lower case; an item of fewer words is one
    shingle of that many, and so must occur whole. Texts that are null or have no word
    contain nothing and are contained nowhere. Documents are told apart by 128 bits of id and
    text, so a null id and an id with several texts do no harm; rows equal in both give one
    row. The same holds for items. Empty tables give no rows; other columns are ignored.

    Candidates go by the hashes of shingles, and are verified on the shingles' words. The
    items' hashes are broadcast if there are at most ``BROADCAST_HASHES``, counted first, and
    then shingles that no sketch has are never shuffled; beyond that all hashes are
    shuffled, 8 bytes and the document's key each, in proportion to the texts. For
    verifying, shingles of candidate documents are shuffled, those of items broadcast up
    to a counted ``BROADCAST_ROWS``.
    """
    own = docs.select(_key(doc_id, text).alias("doc"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    small = written(item_shingles(items, width, threshold, item_id, text), "item-shingles")
    sizes = small.groupBy("width").agg(F.count(F.lit(1)).alias("n"))
    # At most ``width`` of them.
    widths = {r.width: r.n for r in sizes.collect()} or {width: 0}
    # Exploded, so that no filter on the words is moved in front and works them out again.
    w = F.explode(F.array(words(_lowered(F.col("text"))))).alias("w")
    cut = own.select("doc", w)
    found = [_candidates(cut, small.where((F.col("width") == k) & F.col("in_sketch")), k) for k in widths]
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.union(more)
    candidates = written(candidates, "candidates")

    docs_ = candidates.select("doc").distinct()
    again = own.join(docs_, "doc", "left_semi").distinct()
    again = again.select("doc", "doc_id", w)
    shared = []
    for k, n in widths.items():
        every = small.where(F.col("width") == k).drop("width", "in_sketch")
        every = F.broadcast(every) if n <= BROADCAST_ROWS else every
        shared.append(_shingles(again, k, "doc", "doc_id", texts=True).join(every, ["hash", "shingle"]))
    both = shared[0]
    for more in shared[1:]:
        both = both.union(more)
    counted = both.groupBy("doc", "doc_id", "item", "item_id", "need", "n_shingles").agg(
        F.count_distinct("shingle").alias("n_shared")
    )
    return (
        counted.where(F.col("n_shared") >= F.col("need"))
        .join(candidates, ["doc", "item"], "left_semi")
        .select("doc", "doc_id", "item_id", "n_shared", "n_shingles")
    )


def without_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that contain none of ``items``, as ``find_items`` has it."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), _key(doc_id, text).alias("doc"))
    found = find_items(docs, items, doc_id=doc_id, text=text, **options).select("doc").distinct()
    return rows.join(found, "doc", "left_anti").select("row.*")


def _key(doc_id: str, text: str) -> Column:
    return F.struct(F.xxhash64(doc_id, text).alias("one"), F.xxhash64(F.lit(1), doc_id, text).alias("two"))
