"""Ranked lexical search: sums over short lists first, then documents over long ones.

Documents are dealt as they lie, and a task ranks its own in blocks. Within a block the
lists of a query's rare terms are short: they are added up term by term (TAAT) into
accumulators, which then count as one more list, with the largest sum as its bound. What
is left are the long lists of frequent terms, whose terms weigh little. They are gone
through document by document (DAAT) in the way of MaxScore: with the score of the tenth
best document so far as the threshold, lists whose bounds together stay below it cannot
bring in a document by themselves, so most of their entries are skipped and they are only
looked up for documents that other lists bring in and that can still get there.

Each task gives at most ``k`` rows for a query, and those are ranked in the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._arrow import pieces, utf8
from millrace.llm._scratch import written
from millrace.llm._split import lowered, split_runs
from millrace.llm._words import LOWER, UPPER

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SLICE_BYTES = 4 << 20
# Terms of items that are worked on at once, and so the size of what tasks are sent.
MOST_TERMS = 500_000
# Documents and postings of a block.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 15, 1 << 21
# Lists are short as long as they come to this share of a block's documents together.
SHORT_SHARE = 0.25
_NO_ID = np.iinfo(np.int64).max


def _inside(data: np.ndarray) -> np.ndarray:
    low = data | 0x20
    letter = (low >= 0x61) & (low <= 0x7A) & (data < 0x80)
    return letter | (data >= 0x80) | ((data >= 0x30) & (data <= 0x39))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, A-Z in lower case; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)))


def _postings(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """``doc_id``, ``n`` (terms, with repeats) of each document that has a term, and which of
    ``terms`` it holds (``term``) how often (``tf``)."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {term: k for k, term in enumerate(sent.value.to_pylist())}
        width = max(len(place), 1)
        for batch in pieces(batches, "text", SLICE_BYTES):
            data, rows = utf8(batch.column("text"))
            found, first = split_runs(lowered(data), rows, _inside(data))
            names = found.dictionary.to_pylist()
            known = np.fromiter((place.get(w, -1) for w in names), np.int64, len(names))
            term = known[found.indices.to_numpy()]
            n = np.diff(first)
            doc = np.repeat(np.arange(batch.num_rows), n)[term >= 0]
            pair, tf = np.unique(doc * width + term[term >= 0], return_counts=True)
            cut = np.searchsorted(pair // width, np.arange(batch.num_rows + 1))
            cut = pa.array(cut, pa.int32())
            made = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(cut, pa.array((pair % width).astype(np.int32))),
                    pa.ListArray.from_arrays(cut, pa.array(tf.astype(np.int32))),
                ],
                ["doc_id", "n", "term", "tf"],
            )
            yield made.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


@dataclass
class List:
    """Documents of a block in ascending order, with a score each, none above ``bound``."""

    docs: np.ndarray
    scores: np.ndarray
    bound: int

    def look_up(self, docs: np.ndarray) -> np.ndarray:
        """The scores of ``docs``, 0 where the list does not have them."""
        at = np.searchsorted(self.docs, docs)
        at[at == len(self.docs)] = 0
        return np.where(self.docs[at] == docs, self.scores[at], 0)


def added(lists: list[List]) -> List:
    """Term at a time: one list of the sums."""
    docs, place = np.unique(np.concatenate([x.docs for x in lists]), return_inverse=True)
    scores = np.zeros(len(docs), np.int64)
    np.add.at(scores, place, np.concatenate([x.scores for x in lists]))
    return List(docs, scores, max(int(scores.max()), 0))


@dataclass
class Best:
    """The ``k`` best documents of a query so far: higher scores first, then smaller ids."""

    k: int
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def threshold(self) -> int:
        """The least score that can still get in; 1 at least."""
        return max(int(self.scores[-1]), 1) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.threshold
        scores = np.concatenate([self.scores, scores[good]])
        ids = np.concatenate([self.ids, ids[good]])
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= least], ids[scores >= least]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search(lists: list[List], ids: np.ndarray, best: Best) -> int:
    """Offer ``best`` the documents of a block that can get in; ``ids`` has their ids.

    Gives how many entries of long lists were left untouched as a whole list is skipped.
    """
    lists = sorted((x for x in lists if len(x.docs)), key=lambda x: len(x.docs))
    budget, short = max(SHORT_SHARE * len(ids), 64), 0
    while short < len(lists) and budget >= len(lists[short].docs):
        budget -= len(lists[short].docs)
        short += 1
    iterators = lists[short:]
    if short:
        iterators = [*iterators, added(lists[:short])]
    # Lists of the least bounds first, which bring in no document while those stay below.
    iterators.sort(key=lambda x: x.bound)
    sums = np.cumsum([x.bound for x in iterators])
    done = np.zeros(0, np.int64)
    skipped = 0
    # The one that bounds most goes first, so that it raises the threshold for the next.
    for k in range(len(iterators) - 1, -1, -1):
        if sums[k] < best.threshold:
            skipped = sum(len(x.docs) for x in iterators[: k + 1])
            break
        docs = iterators[k].docs
        scores = iterators[k].scores.copy()
        # Documents of lists that went before have been scored with this one.
        if len(done):
            new = ~np.isin(docs, done, assume_unique=True)
            docs, scores = docs[new], scores[new]
        done = docs if not len(done) else np.union1d(done, docs)
        for other in range(k - 1, -1, -1):
            may = scores + sums[other] >= best.threshold
            docs, scores = docs[may], scores[may]
            if not len(docs):
                break
            scores = scores + iterators[other].look_up(docs)
        best.offer(scores, ids[docs])
    return skipped


class _Block:
    """Postings of some documents by term, with their scores."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int):
        ids = batch.column("doc_id")
        self.ids = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        n = batch.column("n").to_numpy()
        lists = batch.column("term")
        doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        term = lists.flatten().to_numpy()
        tf = batch.column("tf").flatten().to_numpy().astype(np.int64)
        m = 100 - 90 + (90 * n * n_docs) // n_terms
        score = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.docs, self.scores, term = doc[order], score[order], term[order]
        self.terms, self.starts = np.unique(term, return_index=True)
        self.stops = np.append(self.starts[1:], len(term))
        tops = np.maximum.reduceat(self.scores, self.starts) if len(term) else np.zeros(0, np.int64)
        # A document without the term scores 0.
        self.bounds = np.maximum(tops, 0)

    def lists(self, terms: np.ndarray) -> list[List]:
        if not len(self.terms):
            return []
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        at = at[self.terms[at] == terms]
        return [
            List(self.docs[a:b], self.scores[a:b], int(bound))
            for a, b, bound in zip(self.starts[at], self.stops[at], self.bounds[at], strict=True)
        ]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they are a block."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        (whole,) = pa.Table.from_batches(held).combine_chunks().to_batches()
        held.clear()
        return whole

    docs = postings = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        docs += batch.num_rows
        postings += len(batch.column("term").flatten())
        if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
            docs = postings = 0
            yield joined()
    if held:
        yield joined()


def _ranked(
    postings: DataFrame, queries: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int, k: int
) -> DataFrame:
    """``item``, ``doc_id`` and ``score`` of the best documents of each task."""
    items = queries["item"].to_numpy()
    own = queries["terms"].combine_chunks()
    terms, cut = own.flatten().to_numpy(), np.append(0, np.cumsum(own.value_lengths()))
    sent = postings.sparkSession.sparkContext.broadcast((items, terms, cut, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, cut, weights = sent.value
        best = [Best(k) for _ in items]
        for batch in _blocks(batches):
            block = _Block(batch, weights, n_docs, n_terms)
            for q, found in enumerate(best):
                search(block.lists(terms[cut[q] : cut[q + 1]]), block.ids, found)
        sizes = [len(b.ids) for b in best]
        ids = np.concatenate([b.ids for b in best]) if best else np.zeros(0, np.int64)
        scores = np.concatenate([b.scores for b in best]) if best else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(items, sizes), pa.int64()),
                pa.array(ids, mask=ids == _NO_ID),
                pa.array(scores),
            ],
            ["item", "doc_id", "score"],
        )

    return postings.mapInArrow(run, "item long, doc_id long, score long")


def best_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score``: the ``k`` best documents of each item.

    Terms are the longest runs of ASCII letters and digits and of all characters beyond
    ASCII, A-Z in lower case. With ``N`` documents that have a term, ``L`` terms in them,
    ``n`` in one, ``df`` documents that hold a term and ``tf`` times it occurs in one, a
    document's score is the sum over an item's distinct terms of
    ``w * ((10**9 * tf) div (1000 * tf + 8 * m))`` with ``w = floor(1000 * ln((2 * N + 2) /
    (2 * df + 1)))`` and ``m = 100 - 90 + (90 * n * N) div L``. Only scores above 0 are
    ranked, equal ones by ascending ``doc_id`` (bigint; null last). ``w`` is negative for a
    term in more than half of the documents.

    A null text has no terms; a document without terms counts nowhere, an item without any
    has no rows. Each row of ``docs`` is a document, repeated ones too. Items equal in id
    and text are one; those equal in id alone are ranked apart. Empty tables give no
    rows; other columns are ignored.

    Tasks are sent the terms of at most about ``MOST_TERMS`` pairs of item and term; more
    items than that are taken in groups by a hash, each with a pass of its own, so any
    number of items will do. An item's distinct terms must fit a task.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    asked = asked.select("item_id", terms_of(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    asked = asked.withColumn("item", F.monotonically_increasing_id())
    asked = written(asked, "search-items")
    n_pairs = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = -(-n_pairs // MOST_TERMS) or 1
    found = [
        _group(own, asked.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g), k) for g in range(groups)
    ]
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _group(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    rows = asked.select("item", "terms").toArrow()
    coded = rows["terms"].combine_chunks()
    each = coded.flatten().dictionary_encode()
    queries = pa.table(
        {"item": rows["item"], "terms": pa.ListArray.from_arrays(_cut(coded), each.indices.cast(pa.int32()))}
    )
    terms = each.dictionary.cast(pa.binary())
    postings = written(_postings(docs, terms), "postings")
    n_docs, n_terms = (x or 0 for x in postings.agg(F.count("n"), F.sum("n")).first())
    held = postings.select(F.explode("term").alias("term")).groupBy("term")
    held = held.agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(terms), np.int64)
    df[held["term"].to_numpy()] = held["df"].to_numpy()
    weights = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    return _ranked(postings, queries, weights, n_docs, max(n_terms, 1), k)


def _cut(lists: pa.Array) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(lists.value_lengths().to_numpy())), pa.int32())
