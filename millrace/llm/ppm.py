"""Scores of texts under prediction by partial matching, beside a word unigram model.

PPM predicts a byte from the longest context that has been seen, and escapes to a
shorter one for a byte that is new there. The trie has all contexts of up to four bytes
that occur in training texts, however rare, so it grows with the corpus; it is a table of
(context, byte, count), never an object in one place. An escape has the weight of the
number of distinct bytes seen (method C), and bytes that a longer context has seen are
excluded from the shorter one's counts. A byte seen in a context has been seen in its
suffix, so what to exclude depends on the next longer context alone, and a byte's
probability on the counts of its contexts and of their suffixes. All contexts that end
in the same two bytes lie together, at most 2**24 rows, so that each task works the
probabilities of its part of the trie out by grouped sums; those of one byte and none
are 2**16 counts and are sent to all.

What a text needs are the probabilities of its grams (a byte behind its four-byte context).
Grams of a large share of all bytes are sent to every task, and the others are joined.

A text is its bytes, A-Z in lower case, and an end; byte FF, which no UTF-8 text
holds, stands for the end and, four times, for what comes before a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._arrow import pieces, utf8
from millrace.llm._scratch import written
from millrace.llm._split import lowered, split_words

ORDER = 4
END = 0xFF
# Words and grams of a larger share are sent to every executor: fewer than its inverse,
# whatever the corpus.
FREQUENT_SHARE = 2.0**-18
FREQUENT_GRAMS = 2.0**-21
SLICE_BYTES = 4 << 20
# Rows of the trie that are worked on at once, and what is left of the part they end in.
TRIE_ROWS = 1 << 20


def stream(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end, the five bytes up to it as a number; and
    where each text starts."""
    lengths = np.diff(rows)
    starts = rows[:-1] + (ORDER + 1) * np.arange(len(lengths))
    out = np.full(len(data) + (ORDER + 1) * len(lengths), END, np.uint8)
    text = np.repeat(starts + ORDER - rows[:-1], lengths) + np.arange(len(data))
    out[text] = data
    coded = np.ones(len(out), bool)
    for k in range(ORDER):
        coded[starts + k] = False
    at = np.flatnonzero(coded)
    grams = out[at].astype(np.uint64)
    for k in range(1, ORDER + 1):
        grams |= out[at - k].astype(np.uint64) << np.uint64(8 * k)
    return grams, rows[:-1] + np.arange(len(lengths))


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams once each, and for every one the place of its own."""
    coded = pa.array(grams).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def gram_counts(docs: DataFrame) -> DataFrame:
    """``gram`` (a byte behind its four-byte context), ``n`` in the rows that are not ``held_out`` and
    ``uses`` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            data, rows = utf8(batch.column("text"))
            grams, starts = stream(lowered(data), rows)
            learnt = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            each = np.repeat(learnt, np.diff(np.append(starts, len(grams))))
            grams, code = _distinct(grams)
            n, uses = np.bincount(code[each], minlength=len(grams)), np.bincount(code, minlength=len(grams))
            columns = [pa.array(grams.view(np.int64)), pa.array(n), pa.array(uses)]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "n", "uses"])

    counted = docs.select("text", "held_out").mapInArrow(run, "gram long, n long, uses long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (bytes; empty for the end of a text) and ``n``, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 * SLICE_BYTES):
            data, rows = utf8(batch.column("text"))
            words, _ = split_words(lowered(data), rows)
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            names = pa.concat_arrays([words.dictionary, pa.array([b""], pa.large_binary())])
            columns = [names.cast(pa.binary()), pa.array(np.append(n, batch.num_rows))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class _Level:
    """Counts of one context length: a row for each context and byte in ``keys`` (context, byte)."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.contexts, self.of = np.unique(keys >> np.uint64(8), return_inverse=True)
        self.n = n
        size = len(self.contexts)
        self.total = np.bincount(self.of, n, size)
        self.seen = np.bincount(self.of, n > 0, size)

    def shared(self, shorter_n: np.ndarray) -> np.ndarray:
        """For each context, the counts in its suffix of the bytes that it has seen itself."""
        return np.bincount(self.of, np.where(self.n > 0, shorter_n, 0), len(self.contexts))


def log_probabilities(grams: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Log10 probability of the last byte of each gram behind its others.

    ``n`` counts the grams in training; ``grams`` are distinct and, of those with the same last
    two bytes of context, all that have a count are among them. ``pairs`` counts the two last
    bytes, 256 by 256.
    """
    symbol = (grams & np.uint64(0xFF)).astype(np.intp)
    n = n.astype(float)
    # Rows of the shorter levels, and each row's own among those of the next shorter one.
    four = _Level(grams, n)
    keys3, to3 = np.unique(grams & np.uint64((1 << 32) - 1), return_inverse=True)
    three = _Level(keys3, np.bincount(to3, n, len(keys3)))
    keys2, to2 = np.unique(keys3 & np.uint64((1 << 24) - 1), return_inverse=True)
    two = _Level(keys2, np.bincount(to2, three.n, len(keys2)))
    last = (two.contexts & np.uint64(0xFF)).astype(np.intp)
    one_n = pairs[last[two.of], (keys2 & np.uint64(0xFF)).astype(np.intp)]
    one_total, one_seen = pairs.sum(axis=1), (pairs > 0).sum(axis=1)
    none = pairs.sum(axis=0)

    # Each gram's context at every level: count of the byte, total, seen bytes; and the same of
    # its suffix without what it has seen.
    row2 = to2[to3]
    c4, c3, c2 = four.of, three.of[to3], two.of[row2]
    c1 = last[c2]
    levels = [
        (n, four.total[c4], four.seen[c4]),
        (three.n[to3], three.total[c3], three.seen[c3]),
        (two.n[row2], two.total[c2], two.seen[c2]),
        (pairs[c1, symbol], one_total[c1], one_seen[c1]),
        (none[symbol], np.full(len(n), none.sum()), np.full(len(n), (none > 0).sum())),
    ]
    hidden = [
        four.shared(three.n[to3])[c4],
        three.shared(two.n[to2])[c3],
        two.shared(one_n)[c2],
        np.where(pairs > 0, none, 0).sum(axis=1)[c1],
    ]
    out = np.zeros(len(n))
    open_ = np.ones(len(n), bool)
    # What is excluded comes from the next longer context, if that has been seen.
    gone, gone_seen = np.zeros(len(n)), np.zeros(len(n))
    for k, (count, total, seen) in enumerate(levels):
        left, new = total - gone, seen - gone_seen
        weight = left + np.where(seen < 256, new, 0)
        hit = open_ & (count > 0)
        out[hit] += np.log10(count[hit] / weight[hit])
        open_ &= ~hit
        # With nothing left to see there, the way to the shorter context is free.
        escape = open_ & (weight > 0)
        out[escape] += np.log10(np.maximum(new[escape], 1e-300) / weight[escape])
        if k < len(hidden):
            gone = np.where(total > 0, hidden[k], 0)
            gone_seen = np.where(total > 0, seen, 0)
    out[open_] -= np.log10(np.maximum(256 - levels[-1][2][open_], 1))
    return out


def trie(grams: DataFrame) -> DataFrame:
    """``gram``, ``uses`` and ``logp`` of each of ``gram_counts``."""
    low = F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("pair")
    found = grams.groupBy(low).agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(1 << 16)
    pairs[found["pair"].to_numpy()] = found["n"].to_numpy()
    pairs = pairs.reshape(256, 256)
    part = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    parts = grams.select(part.alias("part"), "gram", "n", "uses").repartition("part").sortWithinPartitions("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def worked(rows: pa.Table) -> pa.RecordBatch:
            own = rows["gram"].to_numpy().view(np.uint64)
            found = log_probabilities(own, rows["n"].to_numpy(), pairs)
            columns = [*(rows[c].combine_chunks() for c in ("gram", "uses")), pa.array(found)]
            return pa.RecordBatch.from_arrays(columns, ["gram", "uses", "logp"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < TRIE_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            part = rows["part"].to_numpy()
            # The last part may go on.
            whole = int(np.searchsorted(part, part[-1]))
            if whole:
                yield worked(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
            size = len(part) - whole
        if size:
            yield worked(pa.Table.from_batches(held))

    return parts.mapInArrow(run, "gram long, uses long, logp double")


def score_texts(
    docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Both models learn from the rows where ``training`` is true (null: not) and score
    all rows. Tokens are the words, A-Z in lower case, and an end. ``base_score`` sums
    ``log10((c + 1) / (N + V + 1))`` over tokens: ``c`` counts the token among the ``N``
    training tokens, of which ``V`` are distinct; ``n_known`` tokens have a ``c``.
    ``score`` is the PPM model's log10 probability of the text. A null text is empty:
    one token, its end. Null and repeated ids get a row each; without training rows
    all bytes are equally likely. Empty tables give no rows; other columns are ignored.

    Counts of words and log probabilities of grams are joined, not broadcast, but for words of
    at least ``FREQUENT_SHARE`` of all tokens and grams of at least ``FREQUENT_GRAMS`` of all
    bytes, of which there are fewer than the inverse; so no key of the joins is hot, and the
    model is nowhere in one piece.
    """
    spark = docs.sparkSession
    held = ~F.coalesce(training, F.lit(False))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held.alias("held_out"))
    learnt = own.where(~F.col("held_out"))
    model = written(trie(written(gram_counts(own), "grams")), "trie")
    uses = model.agg(F.sum("uses")).first()[0] or 0
    known = model.where(F.col("uses") >= uses * FREQUENT_GRAMS).orderBy("gram").select("gram", "logp").toArrow()
    sent = (known["gram"].to_numpy().view(np.uint64), known["logp"].to_numpy().astype(np.float32))
    tables = spark.sparkContext.broadcast(sent)
    counts = written(word_counts(learnt), "word-counts")
    ends = F.max(F.when(F.length("word") == 0, F.col("n")))
    found = counts.agg(F.sum("n"), F.count("n"), ends).first()
    total, distinct, end = (x or 0 for x in found)
    often = counts.where((F.col("n") >= total * FREQUENT_SHARE) & (F.col("n") > 0)).toArrow()
    frequent = spark.sparkContext.broadcast(
        dict(zip(often["word"].to_pylist(), often["n"].to_pylist(), strict=True))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (common, logp) = frequent.value, tables.value
        for batch in pieces(batches, "text", SLICE_BYTES):
            data, rows = utf8(batch.column("text"))
            data = lowered(data)
            grams, starts = stream(data, rows)
            grams, gram_code = _distinct(grams)
            at = np.minimum(np.searchsorted(common, grams), max(len(common) - 1, 0))
            hit = common[at] == grams if len(common) else np.zeros(len(grams), bool)
            value = np.where(hit, logp[at] if len(common) else 0.0, 0.0)
            score = np.add.reduceat(value[gram_code], starts, dtype=np.float64)
            gram_doc = np.repeat(np.arange(batch.num_rows), np.diff(np.append(starts, len(gram_code))))
            rare_grams, gram_times, gram_cut = _each(gram_doc, gram_code, ~hit, batch.num_rows)
            words, first = split_words(data, rows)
            names = words.dictionary.to_pylist()
            n = np.fromiter((known.get(w, 0) for w in names), np.int64, len(names))
            code = words.indices.to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            c = n[code]
            sums = np.bincount(doc, np.log10(c + 1.0), batch.num_rows) + np.log10(end + 1.0)
            n_known = np.bincount(doc[c > 0], minlength=batch.num_rows) + (end > 0)
            rare, times, cut = _each(doc, code, n == 0, batch.num_rows)
            columns = [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(np.diff(first) + 1),
                pa.array(n_known),
                pa.array(sums),
                pa.array(score),
                pa.ListArray.from_arrays(cut, words.dictionary.take(pa.array(rare)).cast(pa.binary())),
                pa.ListArray.from_arrays(cut, pa.array(times)),
                pa.ListArray.from_arrays(gram_cut, pa.array(grams[rare_grams].view(np.int64))),
                pa.ListArray.from_arrays(gram_cut, pa.array(gram_times)),
            ]
            yield pa.RecordBatch.from_arrays(columns, _SCORED)

    id_type = own.schema["doc_id"].dataType.simpleString()
    scored = own.mapInArrow(
        run,
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, sums double, "
        "score double, rare array<binary>, times array<long>, grams array<long>, gram_times array<long>",
    )
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    each = scored.select("row", F.inline(F.arrays_zip("rare", "times"))).toDF("row", "word", "times")
    seldom = counts.where((F.col("n") < total * FREQUENT_SHARE) & (F.col("n") > 0))
    more = each.join(seldom, "word").groupBy("row")
    more = more.agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"),
        F.sum("times").alias("known"),
    )
    each = scored.select("row", F.inline(F.arrays_zip("grams", "gram_times"))).toDF("row", "gram", "times")
    seldom = model.where(F.col("uses") < uses * FREQUENT_GRAMS).select("gram", "logp")
    rest = each.join(seldom, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("logp")).alias("rest"))
    every = F.log10(F.lit(float(total + distinct + 1)))
    return scored.join(more, "row", "left").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * every).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )


def _each(
    doc: np.ndarray, code: np.ndarray, wanted: np.ndarray, n_docs: int
) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The ``wanted`` codes of each document once, how often they occur there, and where those of
    each document start and the last end."""
    chosen = wanted[code]
    width = max(len(wanted), 1)
    pair, times = np.unique(doc[chosen] * width + code[chosen], return_counts=True)
    cut = np.searchsorted(pair // width, np.arange(n_docs + 1))
    return pair % width, times, pa.array(cut, pa.int32())


_SCORED = ["doc_id", "held_out", "n_tokens", "n_known", "sums", "score", "rare", "times", "grams", "gram_times"]
