"""Byte-level BPE by way of a sentencepiece model that is written, not trained.

A byte-level vocabulary is a list of byte strings in order of rank. Each byte is
mapped to a printable character, each byte string becomes a piece whose score is
its negative rank, and normalisation is switched off: sentencepiece then joins
the pair of lowest rank first, leftmost on ties, as byte-level BPE does. The
pattern's matches are encoded one by one; decoding maps ids to pieces to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm._arrow import appended, binary_rows, pieces, utf8
from millrace.llm._chunks import ChunkStore

_NORMAL, _UNKNOWN = 1, 2
_BPE = 2
# Of texts or ids at a time: a worker holds about 20 times as much.
SLICE_BYTES = 4 << 20


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else one from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in keep else next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Byte strings in order of rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        ranked = sorted((int(r), base64.b64decode(b)) for b, r in map(bytes.split, lines))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"{path}: ranks must be 0, 1, 2, ... without gaps")
    return [b for _, b in ranked]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _float(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece ``i`` stands for ``tokens[i]``; the unknown piece is last."""
    table = byte_characters()
    out = []
    for rank, token in enumerate(tokens):
        piece = "".join(table[b] for b in token).encode()
        out.append(_bytes(1, _bytes(1, piece) + _float(2, -rank) + _number(3, _NORMAL)))
    out.append(_bytes(1, _bytes(1, b"<unk>") + _float(2, 0) + _number(3, _UNKNOWN)))
    size = len(tokens) + 1
    trainer = _number(3, _BPE) + _number(4, size) + _number(40, len(tokens))
    trainer += _number(41, -1) + _number(42, -1) + _number(43, -1)
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join([*out, _bytes(2, trainer), _bytes(3, normaliser)])


class ByteBpe:
    """Encoder and decoder for one vocabulary file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise(tokens))
        self.matches = regex.compile(pattern).findall
        table = byte_characters()
        self.to_text = bytes(range(256)).decode("latin-1").maketrans(dict(enumerate(table)))
        byte = {c: b for b, c in enumerate(table)}
        pieces_ = self.model.id_to_piece(list(range(len(tokens))))
        decoded = [bytes(byte[c] for c in piece) for piece in pieces_]
        self.lengths = np.fromiter(map(len, decoded), np.int64, len(decoded))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(decoded), np.uint8)
        self.store = ChunkStore(self.encode_chunks)

    def encode_chunks(self, chunks: list[bytes]) -> list[list[int]]:
        matches = [self.matches(c.decode()) for c in chunks]
        distinct = list(dict.fromkeys(m for found in matches for m in found))
        mapped = [m.encode().decode("latin-1").translate(self.to_text) for m in distinct]
        ids = dict(zip(distinct, self.model.encode(mapped, num_threads=1), strict=True))
        return [[i for m in found for i in ids[m]] for found in matches]

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows of ids on end, and where each row starts and the last ends."""
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.starts[ids] - ends[:-1], lengths)
        at += np.arange(ends[-1])
        return self.bytes[at], ends[rows]


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _widened(frame: DataFrame, *new: tuple[str, T.DataType]) -> T.StructType:
    clash = {name for name, _ in new} & set(frame.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    return T.StructType([*frame.schema.fields, *(T.StructField(n, t) for n, t in new)])


def _encoded(
    batches: Iterator[pa.RecordBatch], path: str, pattern: str, text: str
) -> Iterator[pa.RecordBatch]:
    store = _coder(path, pattern).store
    for batch in pieces(batches, text, SLICE_BYTES):
        ids, rows = store.lookup(batch.column(text))
        yield appended(
            batch, n_tokens=pa.array(np.diff(rows)), ids=binary_rows(ids.astype("<u4"), rows)
        )


def _decoded(
    batches: Iterator[pa.RecordBatch], path: str, pattern: str, ids: str
) -> Iterator[pa.RecordBatch]:
    coder = _coder(path, pattern)
    for batch in pieces(batches, ids, SLICE_BYTES):
        data, rows = utf8(batch.column(ids))
        yield appended(
            batch, decoded=binary_rows(*coder.decode(data.view("<u4"), rows // 4))
        )


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` (long) and ``ids``: little-endian unsigned 32-bit ids on end.

    ``path`` is a file of ranks that every executor can open. Special tokens are
    not looked for. A null text counts as empty: no tokens. Other columns, nulls,
    ties and repeated rows pass through; an existing column ``n_tokens`` or
    ``ids`` is an error. No shuffle: a lost task encodes its own rows again.
    """

    schema = _widened(docs, ("n_tokens", T.LongType()), ("ids", T.BinaryType()))
    return docs.mapInArrow(lambda batches: _encoded(batches, path, pattern, text), schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes for a column of ids as ``encode`` gives them.

    Null ids decode to no bytes. An id outside the vocabulary raises.
    """

    schema = _widened(encoded, ("decoded", T.BinaryType()))
    return encoded.mapInArrow(lambda batches: _decoded(batches, path, pattern, ids), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens``, ``ids`` and ``decoded``: both steps in one pass.

    The same as ``encode`` and ``decode`` one after the other, but a task needs one
    Python worker instead of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = _encoded(batches, path, pattern, text)
        bare = (batch.drop_columns([text]) for batch in encoded)
        yield from _decoded(bare, path, pattern, "ids")

    new = [("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("decoded", T.BinaryType())]
    return docs.mapInArrow(run, _widened(docs.drop(text), *new))
