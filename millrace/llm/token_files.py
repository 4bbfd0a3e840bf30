"""Token ids in files of fixed-width packed integers.

An id takes as many bits as the vocabulary needs, most significant first. Ids are
packed in blocks of equally many; each block starts at a whole byte, and a table
of block offsets leads to it, so any range of ids is unpacked by numpy from its
own blocks alone. One file image (a segment) holds whole documents:

    magic "MILLTOK1", then little-endian: bits u32, ids in a block u32,
    documents u64, ids u64, blocks u64, document starts u64 * (documents + 1),
    block offsets u64 * (blocks + 1), packed blocks

Segments are stored as binary values of a Parquet table, because executors write
that to any store Spark reaches and commit it once.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._arrow import pieces, utf8
from millrace.llm._chunks import ChunkStore, cut
from millrace.llm._scratch import partitions

MAGIC = b"MILLTOK1"
HEADER = struct.Struct("<8sIIQQQ")
BLOCK_IDS = 8192
SEGMENT_IDS = 1 << 20
SLICE_BYTES = 4 << 20
# A blank and then characters of one or two bytes of which none is white space.
_PLAIN = re.compile(rb" [\x21-\x7E\x80-\xBF\xC3-\xDF]+").fullmatch
# So many chunks are encoded on end.
RUN = 1000


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids on end, ``bits`` each, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").view(np.uint8)
    wide = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :])


def unpack(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of what ``pack`` gave."""
    if bits in (8, 16, 32):
        return data[: n * bits // 8].view(f">u{bits // 8}").astype(np.uint32)
    own = np.unpackbits(data, count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = own
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


def to_segment(lengths: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    """A file image of documents of these lengths."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = [pack(ids[at : at + block], bits) for at in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    head = HEADER.pack(MAGIC, bits, block, len(lengths), len(ids), len(blocks))
    return b"".join([head, starts.tobytes(), offsets.tobytes(), *map(np.ndarray.tobytes, blocks)])


class Segment:
    """A file image, read by document or by range of ids."""

    def __init__(self, image: bytes):
        magic, self.bits, self.block, self.n_docs, self.n_ids, blocks = HEADER.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        self.starts = np.frombuffer(image, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.offsets = np.frombuffer(image, "<u8", blocks + 1, at).astype(np.int64)
        self.data = np.frombuffer(image, np.uint8)[at + 8 * (blocks + 1) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` (exclusive), from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        found = [
            unpack(
                self.data[self.offsets[b] : self.offsets[b + 1]],
                self.bits,
                min(self.block, self.n_ids - b * self.block),
            )
            for b in range(first, last + 1)
        ]
        base = first * self.block
        return np.concatenate(found)[start - base : stop - base]

    def document(self, index: int) -> np.ndarray:
        return self.ids(int(self.starts[index]), int(self.starts[index + 1]))


class FlatStore(ChunkStore):
    """A store whose ``encode`` gives all ids on end: the chunks in an order of its own, how many
    ids each has, and the ids."""

    def _add(self, chunks: list[bytes]) -> None:
        ordered, lengths, ids = self.encode(chunks)
        n, first = len(ordered), len(self.row)
        while first + n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.lengths[first : first + n] = lengths
        self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.row.update(zip(ordered, range(first, first + n)))

    def _rows(self, chunks: list[bytes]) -> np.ndarray:
        if len(self.row) >= self.limit:
            self.clear()
        rows = np.fromiter(map(self.row.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = [chunks[k] for k in missing.tolist()]
            self._add(new)
            rows[missing] = np.fromiter(map(self.row.__getitem__, new), np.int64, len(new))
        return rows

    def lookup(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, rows = utf8(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts, first = cut(data, rows)
        buffers = [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, buffers)
        coded = chunks.dictionary_encode()
        row = self._rows(coded.dictionary.to_pylist())
        # The ids of each chunk once, and then whole lists of them for all its places.
        lengths = self.lengths[row]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.starts[row] - ends[:-1], lengths) + np.arange(ends[-1])
        each = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(self.ids[at]))
        ids = each.take(coded.indices).flatten().to_numpy()
        places = np.concatenate([[0], np.cumsum(lengths[coded.indices.to_numpy()])])
        return ids, places[first]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.bits = bits_for(self.model.get_vocab_size(with_added_tokens=True))
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.blank = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.store = FlatStore(self.encode, limit=450_000)

    def encode(self, chunks: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The chunks in a new order, and lengths and ids of each. Those of a blank and a word are
        encoded many on end, which is faster, and taken apart before each token that begins with
        the blank."""
        plain, odd = [], []
        for c in chunks:
            (plain if _PLAIN(c) else odd).append(c)
        runs = [plain[at : at + RUN] for at in range(0, len(plain), RUN)]
        lengths, found = [], []
        for run, ids in zip(runs, self._ids([b"".join(run) for run in runs]), strict=True):
            ids = np.array(ids, np.uint32)
            at = np.append(np.flatnonzero(self.blank[ids]), len(ids))
            if len(at) != len(run) + 1:
                raise ValueError("a blank before a word must begin a token")
            lengths.append(np.diff(at))
            found.append(ids)
        others = self._ids(odd)
        lengths.append(np.fromiter(map(len, others), np.int64, len(others)))
        found.append(np.fromiter((i for ids in others for i in ids), np.uint32))
        return plain + odd, np.concatenate(lengths), np.concatenate(found)

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        decoded = [t.decode() for t in texts]
        return [e.ids for e in self.model.encode_batch_fast(decoded, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


_SEGMENT = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("segment", T.LongType()),
        T.StructField("start_in_part", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("image", T.BinaryType()),
    ]
)


def segments(
    docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Segments of all documents in ascending order of ``doc_id``, for writing as Parquet.

    Texts are encoded by the byte-level ``tokenizers`` file at ``path`` (which
    every executor can open), special strings as its default has them, and
    ``end_id`` is put behind each document. A null text is empty: the end id
    alone. A null ``doc_id`` sorts first and is kept; equal ids sort by a hash of
    the text and then by the text. An empty table gives no segment. Other columns
    are ignored. One shuffle, by ranges of id and hash, so that no id can fill a
    partition; a task holds one segment,
    which ends behind the slice of texts that fills it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first()]
    ordered = rows.repartitionByRange(partitions(spark), *order[:2]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(path), TaskContext.get().partitionId()
        keys: list[int | None] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = number = start = 0

        def segment() -> pa.RecordBatch:
            image = to_segment(np.concatenate(lengths), np.concatenate(held), encoder.bits)
            row = [[part], [number], [start], [size], [list(keys)], [image]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            columns = [pa.array(v, t) for v, t in zip(row, types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, _SEGMENT.names)

        for batch in pieces(batches, "text", SLICE_BYTES):
            ids, at = encoder.store.lookup(batch.column("text"))
            ids = np.insert(ids, at[1:], end_id)
            keys += batch.column("doc_id").to_pylist()
            lengths.append(np.diff(at) + 1)
            held.append(ids)
            size += len(ids)
            if size >= SEGMENT_IDS:
                yield segment()
                start, number, size = start + size, number + 1, 0
                keys, lengths, held = [], [], []
        if keys:
            yield segment()

    return ordered.mapInArrow(run, _SEGMENT)


def documents_of(stored: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, from stored segments.

    ``start`` counts the ids of all documents before it. The totals of parts (one
    row for each partition that was written, so bounded by their number) are
    summed up in one task and broadcast; images are not shuffled.
    """
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = stored.join(F.broadcast(bases), "part").select(
        (F.col("base") + F.col("start_in_part")).alias("start"), "doc_ids", "image"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "image", 1):
            (row,) = batch.to_pylist()
            read = Segment(row["image"])
            ids = read.ids(0, read.n_ids).astype("<u4")
            at = read.starts
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + at[:-1]),
                    pa.array(np.diff(at)),
                    pa.array(crcs, pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
