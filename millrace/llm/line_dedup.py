"""Lines that many documents share, found in ranges of sorted hashes.

Each document gives one row for each distinct key of its lines: 128 bits of hash, the
document and the places. Rows are dealt by ranges of (hash, document), so a key that a
third of all documents hold is split over many tasks like everything else, and sorted by
hash, document and place. A task streams its range and holds back no more rows of a key
than may yet prove too few. Only a range's first and last key can go on in another range;
their rows are marked as open, and a count for each such key, two for a range at most,
settles them. What comes out is a compressed bitmap of the lines to keep for each
document that loses one, not its text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._arrow import appended, pieces, utf8
from millrace.llm._scratch import dropped, written
from millrace.llm._split import lowered

SLICE_BYTES = 4 << 20
_KEY = ("key1", "key2")
_DOC = ("id", "one", "two")


def _identity(text: str) -> list[Column]:
    """Two differently seeded hashes of a text, 128 bits together."""
    content = F.coalesce(text, F.lit(""))
    return [F.xxhash64(content).alias("one"), F.xxhash64(F.lit(1), content).alias("two")]


class Lines:
    """The lines of texts on end: ``starts`` and ``ends`` in bytes, ``n`` of each text."""

    def __init__(self, texts: pa.Array):
        self.data, rows = utf8(texts)
        breaks = np.flatnonzero(self.data == 0x0A)
        self.starts = np.sort(np.concatenate([rows[:-1], breaks + 1]))
        self.ends = np.sort(np.concatenate([breaks, rows[1:]]))
        self.n = np.diff(np.searchsorted(breaks, rows)) + 1

    def keys(self, min_chars: int) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The keys of lines that have ``min_chars`` code points left, and the numbers of those lines."""
        data = self.data
        solid = np.flatnonzero((data != 0x20) & ((data < 0x09) | (data > 0x0D)))
        low, high = np.searchsorted(solid, self.starts), np.searchsorted(solid, self.ends)
        some = np.flatnonzero(high > low)
        start, end = solid[low[some]], solid[high[some] - 1] + 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        enough = points[end] - points[start] >= min_chars
        some, start, end = some[enough], start[enough], end[enough]
        change = np.zeros(len(data) + 1, np.int8)
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)
        inside = np.cumsum(change[:-1], dtype=np.int8) > 0
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(lowered(data[inside]))]
        keys = pa.Array.from_buffers(pa.large_binary(), len(some), buffers)
        return keys.dictionary_encode(), some


def _line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each document and distinct key: the key's hash, the document's identity and
    number of lines, and ``at``: the places of lines with that key in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in pieces(batches, "text", SLICE_BYTES):
            lines = Lines(batch.column("text"))
            keys, line = lines.keys(min_chars)
            digests = b"".join(xxh3_128_digest(k) for k in keys.dictionary.to_pylist())
            hashes = np.frombuffer(digests, "<i8").reshape(-1, 2)
            first = np.concatenate([[0], np.cumsum(lines.n)])
            doc = np.repeat(np.arange(batch.num_rows), lines.n)[line]
            pair = doc * max(len(hashes), 1) + keys.indices.to_numpy()
            order = np.argsort(pair, kind="stable")
            pair, line, doc = pair[order], line[order], doc[order]
            head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))[: len(pair)]
            own, code = doc[head], pair[head] % max(len(hashes), 1)
            offsets = pa.array(np.append(head, len(line)), pa.int32())
            at = pa.ListArray.from_arrays(offsets, pa.array((line - first[doc]).astype(np.int32)))
            rows = pa.array(own)
            columns = [
                pa.array(hashes[code, 0]),
                pa.array(hashes[code, 1]),
                *(batch.column(c).take(rows) for c in _DOC),
                pa.array(lines.n[own], pa.int64()),
                at,
            ]
            yield pa.RecordBatch.from_arrays(columns, [*_KEY, *_DOC, "n_lines", "at"])

    of = docs.schema
    schema = T.StructType(
        [
            *(T.StructField(k, T.LongType()) for k in _KEY),
            *(of[c] for c in _DOC),
            T.StructField("n_lines", T.LongType()),
            T.StructField("at", T.ArrayType(T.IntegerType())),
        ]
    )
    return docs.mapInArrow(run, schema)


class _Stream:
    """Runs of equal keys in sorted batches of one range.

    Rows of a run that is over come out if it has ``least`` rows. The first and the last run
    of the range may go on elsewhere: their rows come out as open, with a row that counts
    them. Fewer than ``least`` rows are held back at any time.
    """

    def __init__(self, least: int, part: int):
        self.least, self.part = least, part
        self.key: tuple[int, int] | None = None
        self.held: list[pa.RecordBatch] = []
        self.n, self.open = 0, True

    def _rows(self, rows: pa.RecordBatch, heads: np.ndarray, open_: bool) -> pa.RecordBatch:
        n = len(heads)
        return appended(
            rows,
            head=pa.array(heads),
            open=pa.array(np.full(n, open_)),
            part=pa.array(np.full(n, self.part, np.int32)),
            n=pa.nulls(n, pa.int64()),
        )

    def _more(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Further rows of the present run."""
        head = np.zeros(rows.num_rows, bool)
        head[0] = self.n == 0
        self.n += rows.num_rows
        if self.open:
            yield self._rows(rows, head, True)
            return
        self.held.append(rows)
        if self.n >= self.least:
            yield from self._free(False)

    def _free(self, open_: bool) -> Iterator[pa.RecordBatch]:
        began = self.n - sum(r.num_rows for r in self.held)
        for rows in self.held:
            head = np.zeros(rows.num_rows, bool)
            head[0] = began == 0
            began += rows.num_rows
            yield self._rows(rows, head, open_)
        self.held = []

    def _count(self, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
        """How many rows of the present run this range has."""
        row = dict.fromkeys(names) | dict(zip(_KEY, self.key))
        columns = [pa.array([row[c]], t) for c, t in zip(names, types, strict=True)]
        counted = self._rows(pa.RecordBatch.from_arrays(columns, names), np.zeros(1, bool), True)
        at = counted.schema.get_field_index("n")
        return counted.set_column(at, "n", pa.array([self.n], pa.int64()))

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            names, types = batch.schema.names, batch.schema.types
            one, two = (batch.column(k).to_numpy() for k in _KEY)
            starts = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
            stops = np.append(starts[1:], batch.num_rows)
            first, last = 0, len(starts) - 1
            if self.key == (one[0], two[0]):
                yield from self._more(batch.slice(0, stops[0]))
                first = 1
                if last == 0:
                    continue
            if self.key is not None:
                if self.open:
                    yield self._count(names, types)
                self.held, self.open = [], False
            # A range's very first run is open; others that end within the batch are settled.
            if self.key is None and last:
                self.key, self.n = (one[0], two[0]), 0
                yield from self._more(batch.slice(0, stops[0]))
                yield self._count(names, types)
                self.open, first = False, 1
            inner = np.arange(first, last)
            inner = inner[stops[inner] - starts[inner] >= self.least]
            if len(inner):
                rows = np.concatenate([np.arange(a, b) for a, b in zip(starts[inner], stops[inner])])
                yield self._rows(batch.take(pa.array(rows)), np.isin(rows, starts[inner]), False)
            self.key, self.n, self.held = (one[starts[last]], two[starts[last]]), 0, []
            yield from self._more(batch.slice(starts[last], stops[last] - starts[last]))
        if self.key is not None:
            # What came out before as settled stays so; the count is for other ranges.
            yield from self._free(True)
            yield self._count(names, types)


def _shared(keys: DataFrame, least: int, keep_first: bool) -> DataFrame:
    """The rows of ``keys`` whose key has ``least`` rows in all; with ``keep_first``, ``at`` of a
    key's first row goes without its first place."""
    order = [*_KEY, F.col("id").asc_nulls_last(), "one", "two"]
    ordered = keys.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _Stream(least, TaskContext.get().partitionId()).run(batches)

    new = (("head", T.BooleanType()), ("open", T.BooleanType()), ("part", T.IntegerType()), ("n", T.LongType()))
    schema = T.StructType([*keys.schema.fields, *(T.StructField(n, t) for n, t in new)])
    found = written(ordered.mapInArrow(run, schema), "shared-lines")
    ends = found.where("n IS NOT NULL").groupBy(*_KEY)
    ends = ends.agg(F.sum("n").alias("all"), F.min("part").alias("first")).where(F.col("all") >= least)
    rows = found.where("n IS NULL").drop("n")
    settled = rows.where("NOT open")
    # Two keys for a range at most, so no more rows than the shuffle has partitions twice.
    ended = rows.where("open").join(F.broadcast(ends), [*_KEY])
    ended = ended.withColumn("head", F.col("head") & (F.col("part") == F.col("first")))
    columns = [*_DOC, "n_lines", "at", "head"]
    # A settled run began in its own range, so its head is the key's first row.
    both = settled.select(*columns).union(ended.select(*columns))
    if keep_first:
        rest = F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0)))
        both = both.withColumn("at", F.when(F.col("head"), rest).otherwise(F.col("at")))
    return both.where(F.size("at") > 0).drop("head")


def pack_bitmap(keep: np.ndarray) -> bytes:
    """One bit for each line, the first one highest, deflated."""
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack_bitmap(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n).astype(bool)


def keep_bitmaps(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``id``, ``one`` and ``two`` (hashes of the text), ``n_lines``, ``n_dropped`` and ``keep`` of each
    document that loses a line; ``keep`` is a bitmap for ``unpack_bitmap``.

    A text is split at ``\\n``; a null or empty one has one empty line. A line's key is the
    line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case. Keys of at least
    ``min_chars`` code points that at least ``min_docs`` documents hold lose all their
    lines, or all but the first in order of id (null last), text hash and place with
    ``keep_first``. Each row is a document of its own in that count, repeated rows
    included; rows equal in id and text share a bitmap and so keep the same lines. With
    ``min_docs`` 1 and ``keep_first``, lines that repeat within a document go as well.
    Empty tables give no rows; other columns are ignored. Keys and texts are told apart by
    128 bits. A text must fit a task, with some 20 times its size.
    """
    content = F.coalesce(text, F.lit(""))
    own = docs.select(F.col(doc_id).alias("id"), *_identity(text), content.alias("text"))
    keys = written(_line_keys(own, min_chars), "line-keys")
    shared = _shared(keys, min_docs, keep_first)
    # Equal rows give equal lists, which partial aggregation makes one.
    gone = shared.groupBy(*_DOC).agg(F.first("n_lines").alias("n_lines"), F.flatten(F.collect_set("at")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bitmaps, counts = [], []
            for n, at in zip(batch.column("n_lines").to_pylist(), batch.column("at"), strict=True):
                keep = np.ones(n, bool)
                keep[at.values.to_numpy()] = False
                bitmaps.append(pack_bitmap(keep))
                counts.append(n - int(keep.sum()))
            yield appended(
                batch.drop_columns(["at"]),
                n_dropped=pa.array(counts, pa.int64()),
                keep=pa.array(bitmaps, pa.binary()),
            )

    kept = [f for f in gone.schema.fields if f.name != "at"]
    new = [T.StructField("n_dropped", T.LongType()), T.StructField("keep", T.BinaryType())]
    bitmaps = written(gone.mapInArrow(run, T.StructType([*kept, *new])), "bitmaps")
    dropped(keys)
    return bitmaps


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``, from what ``keep_bitmaps`` gave for them.

    Lines that stay are joined by ``\\n``; a document without a bitmap keeps its text, a null one
    gives "". An existing column of one of the three names is an error.
    """
    clash = {"n_lines", "n_dropped", "kept_text"} & {*docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    one, two = _identity(text)
    # Rows carry their own columns in one, so that no name can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("own_id"), one, two)
    maps = bitmaps.select("id", F.col("one").alias("_one"), F.col("two").alias("_two"), "keep")
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two"))
    joined = rows.join(maps, same, "left")
    joined = joined.select("row", F.coalesce(F.col("row")[text], F.lit("")).alias("text"), "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            n = Lines(batch.column("text")).n
            texts, maps_ = batch.column("text"), batch.column("keep").to_pylist()
            gone = np.zeros(batch.num_rows, np.int64)
            changed = [k for k, bitmap in enumerate(maps_) if bitmap is not None]
            if changed:
                texts = texts.to_pylist()
                for k in changed:
                    keep = unpack_bitmap(maps_[k], int(n[k]))
                    gone[k] = n[k] - keep.sum()
                    texts[k] = "\n".join(x for x, stays in zip(texts[k].split("\n"), keep) if stays)
                texts = pa.array(texts, pa.string())
            columns = [batch.column("row"), pa.array(n), pa.array(gone), texts.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n_lines", "n_dropped", "kept_text"])

    new = (("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept_text", T.StringType()))
    schema = T.StructType([joined.schema["row"], *(T.StructField(n, t) for n, t in new)])
    return joined.mapInArrow(run, schema).select("row.*", "n_lines", "n_dropped", "kept_text")


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, **options) -> DataFrame:
    """``apply_bitmaps`` of what ``keep_bitmaps`` finds in ``docs`` themselves."""
    names = {k: v for k, v in options.items() if k in ("doc_id", "text")}
    return apply_bitmaps(docs, keep_bitmaps(docs, min_docs, **options), **names)
