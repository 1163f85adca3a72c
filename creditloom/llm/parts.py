"""Results per piece of a text, remembered within a task.

A byte-level tokenizer starts a new token at every single space that stands
between two characters that are not white space. So a text is the first part
and then " part" for each of the others, and each can be worked on alone. Texts
where a part is empty or starts or ends with white space are worked on whole.
Parts of plain characters are cut into pieces further, as the tokenizer does.
Pieces are found and numbered by NumPy and Arrow, so Python sees each once per slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.workers import give_back, lean  # noqa: F401  (for the operators here)

ARROW_ROWS, ARROW_BYTES = "1000", "16m"  # of an Arrow batch, which the JVM and the worker both hold
DOCS = 300  # texts of an Arrow batch turned into Python strings at a time
SLICE_CHARS = 1 << 21  # texts looked at together; bounds the list of parts in memory
REMEMBERED = 600_000  # pieces remembered
LONGEST = 256  # bytes of a part worth remembering


def slices(column: pa.Array, size: int = DOCS) -> Iterator[list]:
    """The values of a column, some at a time."""
    for at in range(0, len(column), size):
        yield column.slice(at, size).to_pylist()


def bound_batches(spark: SparkSession, rows: str = ARROW_ROWS, size: str = ARROW_BYTES) -> None:
    """Texts are long: fewer of them in an Arrow batch than Spark's default of 10,000 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def settle(spark: SparkSession) -> None:
    """Executors return what the work before has left in their heaps: a heap that has grown shrinks in a full collection only."""
    tasks = spark.sparkContext.defaultParallelism
    collected = F.reflect(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, tasks, 1, tasks).select(collected.alias("done")).write.format("noop").mode("overwrite").save()


# --- Pieces of texts ------------------------------------------------------------------

def _printable() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = np.zeros(256, "<u4")
    table[own] = own
    table[table == 0] = np.arange(256, 256 + 256 - len(own))
    return table


PRINTABLE = _printable()
LETTER, DIGIT, MARK, LINE, SPACE = range(1, 6)


def _kinds(special: Iterable[str]) -> np.ndarray:
    """What each byte is to a byte-level tokenizer; 0 where that is not told by the byte alone."""
    table = np.zeros(256, np.uint8)
    table[0x21:0x7F] = MARK
    table[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = LETTER
    table[ord("0"):ord("9") + 1] = DIGIT
    table[ord("\n")], table[0x20] = LINE, SPACE
    table[0x80:0xC0] = table[0xC3] = LETTER  # U+00C0 to U+00FF; other places of 80 to BF are sorted out below
    table[[ord("'"), *(s.encode()[0] for s in special if s)]] = 0
    return table


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large binary column, and where each value begins and the last one ends."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    held = column.buffers()[2]
    return (np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8))[at[0]:at[-1]], at - at[0]


def _running(flags: np.ndarray) -> np.ndarray:
    """How many are true before each place, and in all."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total


class Cutter:
    """Cuts texts where a byte-level tokenizer does.

    A part of ASCII characters and letters up to U+00FF is cut where letters,
    digits, other characters and line ends meet. Parts with anything else, with an
    apostrophe, what special tokens begin with, two line ends in a row or one at
    an end are one piece.
    """

    def __init__(self, special: Iterable[str]):
        self.table = _kinds(special)

    def kinds(self, data: np.ndarray) -> np.ndarray:
        kind = self.table[data]
        follows = (data >= 0x80) & (data < 0xC0)
        follows[1:] &= (data[:-1] != 0xC3) | (data[1:] == 0x97) | (data[1:] == 0xB7)
        kind[follows] = 0
        return kind

    def cut(self, texts: Sequence[str]) -> Cut:
        data, offsets = _bytes(pa.array(texts, pa.large_string()))
        kind = self.kinds(data)
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        begins = begins[:-1]
        part = begins | (kind == SPACE)  # a part begins with its space
        line = kind == LINE
        ends = np.ones(len(data), bool)
        ends[:-1] = part[1:]
        # A line end where a part begins or ends, or after another one.
        odd = (kind == 0) | line & (part | ends)
        odd[1:] |= line[1:] & (line[:-1] | (kind[:-1] == SPACE))
        meet = np.zeros(len(data), bool)
        meet[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
        starts = np.flatnonzero(part)
        whole_parts = np.diff(_running(odd)[np.append(starts, len(data))]) > 0
        meet &= ~np.repeat(whole_parts, np.diff(np.append(starts, len(data))))
        pieces = np.flatnonzero(part | meet)
        # A first part with a line end at its ends looks like a piece of another one.
        heads = np.flatnonzero(begins)
        bound = np.zeros(len(data), bool)
        bound[heads] = line[heads]
        bound[1:] |= line[:-1] & (kind[1:] == SPACE)
        column = pa.Array.from_buffers(pa.large_binary(), len(pieces), [
            None, pa.py_buffer(np.append(pieces, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False)
        return Cut(number, coded.dictionary, np.searchsorted(pieces, offsets), np.diff(_running(bound)[offsets]) > 0)

    def plain(self, pieces: pa.Array) -> tuple[np.ndarray, list[str]]:
        """Which pieces are one token's worth of plain characters, and these in the characters that stand for their bytes."""
        data, offsets = _bytes(pieces)
        sizes = np.diff(offsets)
        if not len(data):
            return np.zeros(len(pieces), bool), []
        kind = self.kinds(data)
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        first = first[:-1]
        same = first.copy()
        same[1:] |= (kind[1:] == kind[:-1]) & (kind[1:] != LINE) | first[:-1] & (kind[:-1] == SPACE) & (kind[1:] != LINE)
        bad = _running((kind == 0) | ~same)
        plain = (bad[offsets[1:]] == bad[offsets[:-1]]) & (sizes > 0)
        plain[plain] &= (sizes[plain] > 1) | (kind[offsets[:-1][plain]] != SPACE)
        data, sizes = data[np.repeat(plain, sizes)], sizes[plain]
        if not len(data):
            return plain, []
        out = np.full(len(data) + len(sizes), ord("\n"), "<u4")
        out[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = PRINTABLE[data]
        return plain, out.tobytes().decode("utf-32-le").split("\n")[:-1]


@dataclass(frozen=True)
class Cut:
    """Some texts in pieces; equal pieces have one number."""

    number: np.ndarray
    pieces: pa.Array  # by number; all but a text's first bring the space in front of them
    first: np.ndarray  # where the pieces of each text begin and the last ones end
    bound: np.ndarray  # texts that can't be cut

    def whole(self, loose: np.ndarray) -> np.ndarray:
        """Texts to be worked on whole: one of their pieces is bound to its neighbours."""
        return self.bound | (np.diff(_running(loose[self.number])[self.first]) > 0)


def is_loose(piece: str) -> bool:
    """White space at its ends binds a part to its neighbours."""
    part = piece.removeprefix(" ")
    return not part or part[-1].isspace() or part is not piece and part[0].isspace()


class PieceCache:
    """Results per piece, remembered: `plain(characters)` gives those of plain pieces, `other(texts)` those of any."""

    def __init__(self, cutter: Cutter, plain: Callable[[list[str]], Sequence[Any]], other: Callable[[list[str]], Sequence[Any]], most: int = REMEMBERED):
        self.cutter, self.plain, self.other, self.most, self.known = cutter, plain, other, most, {}

    def results(self, pieces: pa.Array) -> tuple[list[Any], np.ndarray]:
        """The result of each piece, None for a loose one, and which are loose."""
        words = pieces.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        loose = np.zeros(len(words), bool)
        missing = np.array([at for at, value in enumerate(found) if value is None], np.int64)
        if not len(missing):
            return found, loose
        is_plain, characters = self.cutter.plain(pieces.take(pa.array(missing)))
        others = {at: words[at].decode() for at in missing[~is_plain].tolist()}
        bound = [at for at, piece in others.items() if is_loose(piece)]
        loose[bound] = True
        for at in bound:
            del others[at]
        places = [*missing[is_plain].tolist(), *others]
        values = [*self.plain(characters), *self.other(list(others.values()))]
        for at, value in zip(places, values):
            found[at] = value
        fresh = {words[at]: value for at, value in zip(places, values) if len(words[at]) <= LONGEST}
        # What came first is what comes most; the rest is worked out again.
        room = max(0, self.most - len(self.known))
        self.known.update(fresh if room >= len(fresh) else dict(islice(fresh.items(), room)))
        return found, loose


def in_slices(texts: Sequence[str], chars: int) -> Iterator[Sequence[str]]:
    """Runs of texts of so many characters together, or of one longer text."""
    start = 0
    while start < len(texts):
        end, held = start, 0
        while end < len(texts) and (end == start or held + len(texts[end]) <= chars):
            held += len(texts[end])
            end += 1
        yield texts[start:end]
        start = end
