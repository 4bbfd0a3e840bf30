"""Long repeated passages, by recompression.

Recompression shortens a text in rounds: runs of one symbol become one symbol, then
symbols are dealt to a left and a right half and each left-right pair becomes one
symbol. Names are hashes of what they stand for, so every task gives equal runs and
pairs equal names and a round needs no exchange. Whether a symbol begins at a place
depends on its neighbours alone, so equal passages are cut alike but for a rim at
both ends that is known: round by round, ``_Rounds`` keeps for each window the
symbols that its words determine by themselves. Of the stretches of ``ANCHOR`` such
symbols after ``ROUNDS`` rounds, the one with the least hash is the window's anchor; a
window with fewer symbols falls back to an earlier round, at worst to its words. Equal
windows have equal anchors, and neighbouring windows mostly share one.

Anchors that occur in one place only are thrown out by a grouped count; windows
around the others are verified by 128 bits of hash over their words, in a second
grouped count. Only windows with a repeated anchor are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._arrow import appended, pieces, utf8
from millrace.llm._scratch import dropped, written
from millrace.llm._split import split_words

# A slice of text takes some 40 times its size while it is worked on.
SLICE_BYTES = 2 << 20
# After three rounds a symbol stands for 2.4 words on average (8 at most, but for runs), so
# an anchor for about seven; one in ten words starts one.
ROUNDS, ANCHOR = 3, 3
# Of a number that orders anchors, these bits are a place; the others are a hash.
_PLACE_BITS = 28
# The packed form of an anchor has six bits each for two distances within a window.
LONGEST_WINDOW = 63

_U = np.uint64
_ONE, _TWO = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ _U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _ONE
    x = (x ^ x >> _U(29)) * _TWO
    return x ^ x >> _U(32)


class Words:
    """The words of a slice of texts on end: two hashes each, and where texts start."""

    def __init__(self, texts: pa.Array):
        from xxhash import xxh3_128_digest

        data, rows = utf8(texts)
        coded, self.starts = split_words(data, rows)
        digests = b"".join(xxh3_128_digest(w) for w in coded.dictionary.to_pylist())
        hashes = np.frombuffer(digests, "<u8").reshape(-1, 2)
        codes = coded.indices.to_numpy()
        self.one, self.two = hashes[codes, 0], hashes[codes, 1]

    def windows(self, length: int) -> np.ndarray:
        """Where windows of ``length`` words start that lie within one text."""
        ok = np.zeros(len(self.one) + 1, np.int32)
        lasts = np.maximum(self.starts[1:] - length + 1, self.starts[:-1])
        np.add.at(ok, self.starts[:-1], 1)
        np.add.at(ok, lasts, -1)
        return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


class _Rolling:
    """Hashes of any stretch of words: sums of word hashes times powers of an odd number."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes) + 1
        power = np.full(n, _U(base))
        power[0] = 1
        self.inverse = np.full(n, _U(pow(base, -1, 1 << 64)))
        self.inverse[0] = 1
        power, self.inverse = np.cumprod(power), np.cumprod(self.inverse)
        self.sums = np.zeros(n, _U)
        np.cumsum(hashes * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]


def _rollings(words: Words) -> tuple[_Rolling, _Rolling]:
    return _Rolling(words.one, 0xD6E8FEB86659FD93), _Rolling(words.two, 0xA0761D6478BD642F)


class _Rounds:
    """Rounds over a slice, with the known symbols ``left`` to ``right`` of each window.

    ``start`` says where symbols begin, in words, and where the last ends; the
    arrays of a window hold numbers of symbols of the present round.
    """

    def __init__(self, words: Words, windows: np.ndarray, length: int):
        self.name = words.one.copy()
        self.start = np.arange(len(self.name) + 1)
        self.first = np.zeros(len(self.name) + 1, bool)
        self.first[words.starts] = True
        self.window, self.left, self.right = windows, windows.copy(), windows + length
        self.round = 0

    def _shorten(self, kept: np.ndarray) -> np.ndarray:
        """Leave out boundaries; for each old symbol, the new one it is part of (and the end)."""
        into = np.cumsum(kept) - 1
        self.start = np.append(self.start[:-1][kept], self.start[-1])
        self.first = np.append(self.first[:-1][kept], True)
        return np.append(into, len(self.start) - 1)

    def next(self) -> tuple[np.ndarray, ...]:
        """One round on. Gives the windows that keep fewer than ``ANCHOR`` symbols, and the
        anchor that each had before."""
        self.round += 1
        before = self.name, self.start, self.left, self.right
        # Runs. The first and the last known run may go on outside the window.
        kept = np.ones(len(self.name), bool)
        kept[1:] = (self.name[1:] != self.name[:-1]) | self.first[1:-1]
        heads = np.flatnonzero(kept)
        sizes = np.diff(np.append(heads, len(kept))).astype(_U)
        into = self._shorten(kept)
        name = self.name[heads]
        long = sizes > 1
        name[long] = _mix(name[long] + _mix(sizes[long], 1), 2)
        left, right = into[self.left] + 1, into[self.right - 1]
        # Pairs. Only a right symbol at the left rim, or a left one at the right, can join
        # a symbol outside.
        joins = _mix(name, 2 + self.round) & _U(1) == 1
        kept = np.ones(len(name), bool)
        kept[1:] = joins[:-1] | ~joins[1:] | self.first[1:-1]
        heads = np.flatnonzero(kept)
        pair = np.diff(np.append(heads, len(kept))) == 2
        into = self._shorten(kept)
        merged = name[heads]
        second = name[heads[pair] + 1]
        merged[pair] = _mix(merged[pair] + _mix(second, -1), -2)
        alive = right > left
        inner = np.where(alive, left, 0)
        left = into[inner + joins[inner]]
        last = np.where(alive, right - 1, 0)
        right = into[last + joins[last]]
        alive &= right - left >= ANCHOR
        gone = ~alive
        name, start, old_left, old_right = before
        ended = (self.window[gone], *_least(name, start, old_left[gone], old_right[gone]))
        self.name = merged
        self.window, self.left, self.right = self.window[alive], left[alive], right[alive]
        return ended

    def rest(self) -> tuple[np.ndarray, ...]:
        """The windows that are left, and their anchors in this round."""
        return self.window, *_least(self.name, self.start, self.left, self.right)


def _least(
    name: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Of the stretches of ``ANCHOR`` symbols between ``left`` and ``right``, the words of the one
    with the least hash, the first on ties. Minima are taken from a table of powers of two."""
    if not len(left):
        return left, left
    n = len(name) - ANCHOR + 1
    if n >> _PLACE_BITS:
        raise ValueError("a text has too many words")
    key = name[:n]
    for k in range(1, ANCHOR):
        key = _mix(key + name[k : n + k], -1 - k)
    low = _U((1 << _PLACE_BITS) - 1)
    table = key & ~low | np.arange(n, dtype=_U)
    last = right - ANCHOR + 1
    power = np.log2(last - left).astype(int)
    out = np.empty(len(left), _U)
    for k in range(int(power.max()) + 1):
        of = power == k
        out[of] = np.minimum(table[left[of]], table[last[of] - (1 << k)])
        step = 1 << k
        table[:-step] = np.minimum(table[:-step], table[step:].copy()) if n > step else table[:-step]
    at = (out & low).astype(np.int64)
    return start[at], start[at + ANCHOR]


def anchors(words: Words, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first and last window, where the anchor starts, its key."""
    windows = words.windows(length)
    rounds = _Rounds(words, windows, length)
    found = [rounds.next() for _ in range(ROUNDS)] + [rounds.rest()] if len(windows) else []
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    window, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(window, kind="stable")
    window, begin, end = window[order], begin[order], end[order]
    new = np.ones(len(window), bool)
    same = (begin[1:] == begin[:-1]) & (end[1:] == end[:-1])
    new[1:] = ~same | (window[1:] != window[:-1] + 1)
    head = np.flatnonzero(new)
    last = window[np.append(head[1:], len(window)) - 1]
    window, begin, end = window[head], begin[head], end[head]
    keys = _mix(_Rolling(words.one, 0xD6E8FEB86659FD93).of(begin, end) + end.astype(_U) - begin.astype(_U), 0)
    return window, last, begin, keys


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys lie together, and where each group starts and the last ends."""
    order = np.lexsort(keys)
    new = np.zeros(len(order) + 1, bool)
    new[0] = new[-1] = True
    for key in keys:
        new[1:-1] |= key[order[1:]] != key[order[:-1]]
    return order, np.flatnonzero(new) if len(order) else np.zeros(1, np.int64)


def _rest(values: np.ndarray, heads: np.ndarray) -> pa.Array:
    """All but the first value of each group as a list; null where a group has one value."""
    n = np.diff(heads)
    inner = np.ones(len(values), bool)
    inner[heads[:-1]] = False
    offsets = np.append(0, np.cumsum(n - 1)).astype(np.int32)
    starts = pa.array(offsets, mask=np.append(n == 1, False))
    return pa.ListArray.from_arrays(starts, pa.array(values[inner]))


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """A row for each text and key of its anchors: ``key``, ``number`` (of the text), ``places`` where
    the anchor starts, and ``packed``: first window, steps to the anchor and to the last window,
    of the first run of windows, and ``more`` of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            words = Words(batch.column("text"))
            first, last, begin, keys = anchors(words, length)
            text = np.searchsorted(words.starts, first, side="right") - 1
            packed = first - words.starts[text] << 12 | begin - first << 6 | last - first
            order, heads = _grouped(begin, keys, text)
            begin, packed, keys = begin[order], packed[order], keys[order]
            new = np.ones(len(order), bool)
            new[1:] = begin[1:] != begin[:-1]
            new[heads[:-1]] = True
            # Groups of (key, text): those of (begin, key, text) put together.
            own = text[order]
            same = np.zeros(len(order), bool)
            same[1:] = (keys[1:] == keys[:-1]) & (own[1:] == own[:-1])
            heads = np.append(np.flatnonzero(~same), len(order))
            at = heads[:-1]
            places = np.add.reduceat(new.astype(np.int32), at) if len(at) else at
            columns = [
                pa.array(keys[at].view(np.int64)),
                batch.column("number").take(pa.array(own[at])),
                pa.array(places, pa.int32()),
                pa.array(packed[at], pa.int64()),
                _rest(packed, heads),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "number", "places", "packed", "more"])

    found = "key long, number long, places int, packed long, more array<long>"
    return texts.select("number", "text").mapInArrow(run, found)


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """``one``, ``two`` (hashes), ``number`` (of the text) and the places of each window that ``spans``
    (packed) name, a row for each text: ``at`` the first place, ``more`` the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            words = Words(batch.column("text"))
            spans = batch.column("spans")
            packed = spans.flatten().to_numpy()
            text = np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy())
            first = words.starts[text] + (packed >> 12)
            change = np.zeros(len(words.one) + 1, np.int64)
            np.add.at(change, first, 1)
            np.add.at(change, first + (packed & 63) + 1, -1)
            at = np.flatnonzero(np.cumsum(change) > 0)
            one, two = (r.of(at, at + length).view(np.int64) for r in _rollings(words))
            text = np.searchsorted(words.starts, at, side="right") - 1
            order, heads = _grouped(two, one, text)
            own = order[heads[:-1]]
            place = at - words.starts[text]
            columns = [
                pa.array(one[own]),
                pa.array(two[own]),
                batch.column("number").take(pa.array(text[own])),
                pa.array(place[own], pa.int64()),
                _rest(place[order], heads),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["one", "two", "number", "at", "more"])

    return texts.mapInArrow(run, "one long, two long, number long, at long, more array<long>")


def _without(texts: DataFrame, length: int) -> DataFrame:
    """``number`` of each text, and what is left without the windows at ``at``."""
    names = ["number", "changed_text", "n_removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts_, gone = [], []
            columns = (batch.column(c).to_pylist() for c in ("text", "at"))
            for text, at in zip(*columns, strict=True):
                words = text.encode().split()
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, np.array(at) + length, -1)
                keep = np.cumsum(change[:-1]) == 0
                texts_.append(b" ".join(compress(words, keep)).decode())
                gone.append(len(words) - int(keep.sum()))
            columns = [batch.column("number"), pa.array(texts_, pa.string()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts.mapInArrow(run, "number long, changed_text string, n_removed long")


def _plain(rows: DataFrame) -> DataFrame:
    """``rows`` with ``n_words``, ``plain`` (words with one blank between two) and ``plain_sha``
    in place of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = [t.split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            plain = [b" ".join(w) for w in words]
            yield appended(
                batch.drop_columns(["text"]),
                n_words=pa.array([len(w) for w in words], pa.int64()),
                plain=pa.array(plain, pa.binary()).cast(pa.string()),
                plain_sha=pa.array([sha256(p).hexdigest() for p in plain], pa.string()),
            )

    new = (("n_words", T.LongType()), ("plain", T.StringType()), ("plain_sha", T.StringType()))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, t) for n, t in new)]))


def remove_repeats(docs: DataFrame, length: int = 35, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept_text`` and ``kept_sha256`` (lower-case hex).

    Every word is removed that lies in a window of ``length`` words which also
    starts elsewhere, in the same text or in another row's. All windows are judged
    on the input, so each copy of a passage goes. ``kept_text`` has the other words,
    one blank between two. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A text that
    is null, empty or shorter than a window loses nothing; a null one gives "".
    Rows with equal texts are copies of each other, whatever their other columns,
    so repeated rows lose all their windows. Empty tables give no rows; an existing
    column of one of the four names is an error.

    Texts and windows are told apart by 128 bits, anchors by 64 (which can only add
    candidates). Equal texts are worked on once. A text must fit a task, with some 40 times
    its size.
    """
    if not 12 <= length <= LONGEST_WINDOW:
        raise ValueError(f"windows have 12 to {LONGEST_WINDOW} words")
    new = ("n_words", "n_removed", "kept_text", "kept_sha256")
    clash = {*new} & {*docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    content = F.coalesce(text, F.lit(""))
    # Two differently seeded hashes, 128 bits together.
    identity = [F.xxhash64(content).alias("one"), F.xxhash64(F.lit(1), content).alias("two")]
    texts = docs.select(*identity, content.alias("text")).groupBy("one", "two")
    # Copies shrink before the shuffle, in each map task. Numbers are mostly zero bytes.
    texts = texts.agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    texts = written(texts.withColumn("number", F.monotonically_increasing_id()), "distinct-texts")

    found = written(_anchors(texts, length), "anchors")
    keys = found.groupBy("key").agg(F.sum("places").alias("n")).where("n > 1").select("key")
    # As a table of its own, so that a key of very many texts is split like any skewed join.
    keys = written(keys, "repeated-anchors")
    each = F.concat(F.array("packed"), F.coalesce("more", F.array().cast("array<bigint>")))
    spans = found.join(keys, "key", "left_semi").select("number", each.alias("spans"))
    spans = spans.groupBy("number").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = written(spans, "spans")
    dropped(found)
    dropped(keys)

    # From here on only texts with a repeated anchor are needed, and what the others are called.
    own = written(texts.select("number", "text").join(spans, "number"), "texts-with-spans")
    names = written(texts.select("one", "two", "number", (F.col("copies") > 1).alias("copied")), "text-names")
    dropped(spans)
    dropped(texts)
    # Worked out twice, since that costs less than keeping them.
    windows = _windows(own, length)
    # A row stands for each text and its places, so a sum says whether a window repeats.
    n = F.when(F.col("more").isNull(), 1).otherwise(1 + F.size("more"))
    twice = windows.groupBy("one", "two").agg(F.sum(n).alias("n")).where("n > 1").select("one", "two")
    twice = written(twice, "repeated-windows")
    each = F.concat(F.array("at"), F.coalesce("more", F.array().cast("array<bigint>")))
    hits = windows.join(twice, ["one", "two"], "left_semi").select("number", each.alias("at"))
    hits = hits.groupBy("number").agg(F.flatten(F.collect_list("at")).alias("at"))
    hits = written(hits, "repeated-places")
    dropped(twice)
    changed = written(_without(own.select("number", "text").join(hits, "number"), length), "changed")
    dropped(own)
    dropped(hits)
    known = names.join(changed, "number", "left")
    known = known.where(F.col("copied") | F.col("changed_text").isNotNull())
    known = known.withColumn("sha", F.sha2("changed_text", 256)).drop("number")

    # Rows carry their own columns in one, so that no name can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), *identity, content.alias("text"))
    rows = _plain(rows).join(known, ["one", "two"], "left")
    whole = F.coalesce("copied", F.lit(False)) & (F.col("n_words") >= length)
    return rows.select(
        "row.*",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, "").otherwise(F.coalesce("changed_text", "plain")).alias("kept_text"),
        F.when(whole, F.sha2(F.lit(""), 256))
        .otherwise(F.coalesce("sha", "plain_sha"))
        .alias("kept_sha256"),
    )
