"""Encoding texts by way of their distinct chunks.

Byte-level tokenisers first cut a text by one pattern and encode each match by
itself. A blank or a line feed between two characters that are not white space
always begins a match, so a text may be cut there and its chunks encoded one by
one. Few chunks are new in running text: each is encoded once for a worker and
looked up afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

from millrace.llm._arrow import utf8

# First bytes of UTF-8 characters of which none is white space. All white space
# beyond ASCII begins with C2, E1, E2 or E3, so these four are left out.
_LEAD2 = np.zeros(256, bool)
_LEAD2[0xC3:0xE0] = True
_LEAD3 = np.zeros(256, bool)
_LEAD3[[0xE0, *range(0xE4, 0xF0)]] = True
_LEAD4 = np.zeros(256, bool)
_LEAD4[0xF0:0xF5] = True
_INNER = np.zeros(256, bool)
_INNER[0x80:0xC0] = True
_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
_OPENS = _GRAPHIC | _LEAD2 | _LEAD3 | _LEAD4


def _closes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at byte ``at`` is surely not white space."""
    one, two, three, four = (data[np.maximum(at - back, 0)] for back in range(4))
    long = _INNER[two] & (_LEAD3[three] | _INNER[three] & _LEAD4[four])
    return _GRAPHIC[one] | _INNER[one] & (_LEAD2[two] | long)


def cut(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks start (and the last ends), and the first chunk of each row (and one more)."""
    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[~(edge[at] | edge[at + 1])]
    at = at[_closes(data, at - 1) & _OPENS[data[at + 1]]]
    edge[at] = True
    edge[at[data[at] == 0x0A] + 1] = True
    starts = np.flatnonzero(edge)
    if not len(data):
        starts = np.zeros(1, np.int64)
    return starts, np.searchsorted(starts, rows)


class ChunkStore:
    """Ids (or only their number) of the chunks seen so far by this worker.

    ``encode`` takes a list of chunks as bytes and gives a sequence of id
    sequences, or of lengths if ``lengths_only``. At ``limit`` chunks it starts
    anew, so its memory is bounded.
    """

    def __init__(
        self,
        encode: Callable[[list[bytes]], Sequence],
        lengths_only: bool = False,
        limit: int = 600_000,
    ):
        self.encode, self.lengths_only, self.limit = encode, lengths_only, limit
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.starts = np.zeros(1024, np.int64)
        self.lengths = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def _add(self, chunks: list[bytes]) -> None:
        encoded = self.encode(chunks)
        n, first = len(chunks), len(self.row)
        lengths = np.fromiter(encoded if self.lengths_only else map(len, encoded), np.int64, n)
        while first + n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.lengths[first : first + n] = lengths
        if not self.lengths_only:
            total = int(lengths.sum())
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            flat = (i for ids in encoded for i in ids)
            self.ids[self.used : self.used + total] = np.fromiter(flat, np.uint32, total)
            self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
            self.used += total
        self.row.update(zip(chunks, range(first, first + n), strict=True))

    def _rows(self, chunks: list[bytes]) -> np.ndarray:
        if len(self.row) >= self.limit:
            self.clear()
        find = self.row.get
        missing = [c for c in chunks if find(c) is None]
        if missing:
            self._add(missing)
        return np.fromiter(map(self.row.__getitem__, chunks), np.int64, len(chunks))

    def lookup(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end (none if ``lengths_only``) and where each starts and the last ends."""
        data, rows = utf8(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts, first = cut(data, rows)
        buffers = [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, buffers)
        coded = chunks.dictionary_encode()
        row = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(self.lengths[row])])
        if self.lengths_only:
            return np.zeros(0, np.uint32), ends[first]
        lengths = self.lengths[row]
        at = np.repeat(self.starts[row] - ends[:-1], lengths)
        at += np.arange(ends[-1])
        return self.ids[at], ends[first]
