"""Words of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    upper = (data >= 0x41) & (data <= 0x5A)
    return np.where(upper, data | 0x20, data).astype(np.uint8)


def split_words(data: np.ndarray, rows: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of texts that lie on end, dictionary-coded, and the
    number of the first word of each text (and of one more)."""
    return split_runs(data, rows, (data != 0x20) & ((data < 0x09) | (data > 0x0D)))


def split_runs(
    data: np.ndarray, rows: np.ndarray, inside: np.ndarray
) -> tuple[pa.DictionaryArray, np.ndarray]:
    """As ``split_words``, for the runs of bytes that are ``inside``."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = rows[:-1][rows[:-1] < rows[1:]]
    begins[first] |= inside[first]
    at = np.flatnonzero(begins)
    # Without blanks, each word ends where the next begins.
    solid = data[inside]
    offsets = np.append((np.cumsum(inside) - 1)[at], len(solid)).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(solid)]
    words = pa.Array.from_buffers(pa.large_binary(), len(at), buffers).dictionary_encode()
    return words, np.searchsorted(at, rows)
