"""Words of an Arrow text column by NumPy, without a Python string per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[ord("A"):ord("Z") + 1] += 32


def byte_set(chars: str) -> np.ndarray:
    """A table of the 256 bytes that is true for these ASCII characters."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


class Texts:
    """The bytes of all texts of a column, A-Z in lower case; a null text is empty."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("") if column.null_count else column
        column = column.cast(pa.large_string())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = column.buffers()[2]
        held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        self.offsets = at - at[0]
        self.data = ASCII_LOWER[held[at[0]:at[-1]]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of every maximal run of bytes where `inside` holds, within one text."""
        n = len(inside)
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True  # texts begin here; nothing runs on from the one before
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:n]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def rows(self, places: np.ndarray) -> np.ndarray:
        """The text each byte lies in."""
        return np.searchsorted(self.offsets, places, side="right") - 1

    def words(self, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> pa.Array:
        """The runs as an Arrow binary array; together they are all bytes where `inside` holds."""
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        return pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[inside])])


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of each word, the distinct words)."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
