"""Spelling variants: words one edit apart, by dense tiles of code points.

Words are laid out as padded matrices of code points, one block of words of one
length against another of the same length or one more. Two words are one edit
apart if their common prefix and common suffix together reach the longer length
minus one. Then one of the two covers half of the longer word, so a tile first
compares the front columns and the back columns of all its pairs, and measures
prefix and suffix where either agrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .parts import lean
from .scan import Texts, byte_set, numbered

SHORTEST = 6  # code points of a word
LEAST = 5  # occurrences of a word
RATIO = 5  # times as frequent as a word its form is
BLOCK_WORDS = 8192  # words of a block
BLOCK_POINTS = 1 << 20  # code points of a block, for very long words
TASK_PAIRS = 8  # pairs of blocks compared in a task
TILE_ROWS = 128  # words of one block compared with the other block at a time
WORDS_HELD = 1 << 20  # distinct words a task counts before it passes them on

ASCII_LETTERS = byte_set("abcdefghijklmnopqrstuvwxyz")
LATIN_1 = 0xC3  # first byte of U+00C0 to U+00FF, and of no other character


# --- Counting ---------------------------------------------------------------------------

def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of a-z and of U+00C0 to U+00FF."""
    inside = ASCII_LETTERS[data]
    lead = data == LATIN_1
    inside |= lead
    inside[1:] |= lead[:-1]
    return inside


def _without(word: bytes, at: int) -> bytes:
    text = word.decode()
    return (text[:at] + text[at + 1:]).encode()


def word_counts(
    docs: DataFrame, lose: int | None = None, shortest: int = SHORTEST, *, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(word, n): maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case.

    Runs of fewer than `shortest` code points are left out. `lose` seeds misspellings: with h the crc32 of
    "<key>:<run>", a run loses its code point h % length where `lose` divides h; what is left counts if it is
    still long enough. A null text has no words, a null key is an empty one, repeated rows count again; other
    columns are not looked at. Tasks add up words before the shuffle; memory is bounded by an Arrow batch, the
    longest text and WORDS_HELD.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def passed_on() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in lean(batches):
            texts = Texts(batch.column(1))
            inside = _letters(texts.data)
            starts, ends = texts.runs(inside)
            points = np.zeros(len(inside) + 1, np.int64)
            np.cumsum((texts.data & 0xC0) != 0x80, out=points[1:])
            long = points[ends] - points[starts] >= shortest
            starts, ends = starts[long], ends[long]
            kept = np.zeros(len(inside) + 1, np.int8)
            kept[starts] += 1
            kept[ends] -= 1
            which, distinct = numbered(texts.words(starts, ends, np.cumsum(kept[:-1], dtype=np.int8).astype(bool)))
            distinct = distinct.to_pylist()
            counts = np.bincount(which, minlength=len(distinct))
            if lose and len(distinct):
                pairs, times = np.unique(texts.rows(starts) * len(distinct) + which, return_counts=True)
                begun = [crc32(f"{k or ''}:".encode()) for k in batch.column(0).to_pylist()]
                hashes = np.array([
                    crc32(distinct[w], begun[d]) for d, w in zip((pairs // len(distinct)).tolist(), (pairs % len(distinct)).tolist())])
                for pair, h, n in zip(*(x[hashes % lose == 0].tolist() for x in (pairs, hashes, times))):
                    word = distinct[pair % len(distinct)]
                    counts[pair % len(distinct)] -= n
                    length = len(word.decode())
                    if length > shortest:
                        short = _without(word, h % length)
                        held[short] = held.get(short, 0) + n
            for word, n in zip(distinct, counts.tolist()):
                if n:
                    held[word] = held.get(word, 0) + n
            if len(held) >= WORDS_HELD:
                yield passed_on()
                held.clear()
        yield passed_on()

    rows = docs.select(F.col(key).cast("string"), F.col(text))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- Comparing ----------------------------------------------------------------------------

def _matrix(words: list[str], width: int) -> np.ndarray:
    """(width, words) code points, padded with zeros at the end."""
    flat = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
    return np.ascontiguousarray((flat.astype(np.uint8) if flat.size and flat.max() < 256 else flat).T)


def near_pairs(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(at left, at right) of all pairs one edit apart.

    Words of the left list are all of one length, those of the right list all of that length or all one longer.
    """
    shorter, longer = len(left[0]), len(right[0])
    a, b = _matrix(left, shorter), _matrix(right, longer)
    if a.dtype != b.dtype:
        a, b = a.astype(np.uint32), b.astype(np.uint32)
    front, found = longer // 2, []
    back = min(shorter, longer - front)
    heads = [_lanes(m, range(front)) for m in (a, b)]
    tails = [_lanes(m, range(len(m) - 1, len(m) - 1 - back, -1)) for m in (a, b)]
    # Rows are padded to whole 64-bit words.
    same, other = (np.zeros((TILE_ROWS, -(-len(right) // 8) * 8), bool) for _ in range(2))
    equal = np.empty((TILE_ROWS, len(right)), bool)
    for start in range(0, len(left), TILE_ROWS):
        part = slice(start, start + TILE_ROWS)
        tile = a[:, part]
        size = tile.shape[1]
        for lanes, held in ((heads, same), (tails, other)):
            _agree(lanes, part, held[:size, :len(right)], equal[:size])
        rows, cols = _places(np.bitwise_or(same[:size], other[:size], out=same[:size]))
        prefix = _common(tile, b, rows, cols, [(j, j) for j in range(shorter)])
        suffix = _common(tile, b, rows, cols, [(shorter - 1 - j, longer - 1 - j) for j in range(shorter)])
        near = (prefix + suffix >= longer - 1) & ((prefix < shorter) | (shorter < longer))
        found.append((rows[near] + start, cols[near]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _lanes(matrix: np.ndarray, columns: range) -> list[np.ndarray]:
    """The columns, as many in a 32-bit number as it can hold."""
    many = 4 // matrix.itemsize
    groups = [columns[at:at + many] for at in range(0, len(columns), many)]
    return [sum(matrix[c].astype(np.uint32) << np.uint32(8 * at) for at, c in enumerate(group)) for group in groups]


def _agree(lanes: list[list[np.ndarray]], part: slice, held: np.ndarray, equal: np.ndarray) -> None:
    """Sets `held` for the pairs that are equal in all these columns."""
    held[:] = True
    for a, b in zip(*lanes):
        np.equal(a[part, None], b[None, :], out=equal)
        held &= equal


def _places(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of what is true; few are, so words of eight are looked at first."""
    words = held.view(np.uint64).reshape(-1)
    hit = np.flatnonzero(words != 0)
    which, byte = np.nonzero(words[hit].view(np.uint8).reshape(-1, 8))
    return np.divmod(hit[which] * 8 + byte, held.shape[1])


def _common(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray, columns: list[tuple[int, int]]) -> np.ndarray:
    """How many of these columns agree before the first that does not, for each pair."""
    length, alive = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for i, j in columns:
        alive = alive[a[i, rows[alive]] == b[j, cols[alive]]]
        if not len(alive):
            break
        length[alive] += 1
    return length


def _best(at: np.ndarray, other: np.ndarray, size: int, words: list[str], counts: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Per word: near words, and the most frequent of them; the first in order of code points wins a tie."""
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[other], -counts[other], at))
    at, other = at[order], other[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
    many = np.bincount(at, minlength=size)
    return pa.RecordBatch.from_arrays([
        pa.array([names[i] for i in at[first].tolist()], pa.string()), pa.array(many[at[first]], pa.int64()),
        pa.array(counts[other[first]], pa.int64()), pa.array([words[i] for i in other[first].tolist()], pa.string()),
    ], ["word", "n_near", "near_n", "near"])


def _tiles(words: DataFrame) -> DataFrame:
    """Rows of two blocks of words to compare; each block meets its own length and the next once."""
    sized = words.withColumn("length", F.length("word"))
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.lit(BLOCK_POINTS) / F.col("length"))))
    lengths = materialize(sized.groupBy("length").agg(F.count(F.lit(1)).alias("n")).select(
        "length", F.ceil(F.col("n") / room).cast("long").alias("blocks")), "lengths")
    placed = sized.join(lengths, "length").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")))
    blocks = materialize(placed.groupBy("length", "block").agg(F.collect_list(F.struct("word", "n")).alias("words")), "blocks")
    own = blocks.select(F.col("length").alias("own"), F.col("block").alias("at"))
    with_next = own.withColumn("length", F.explode(F.array("own", F.col("own") + 1))).join(lengths, "length")
    # Of one length, a block meets itself and those after it.
    start = F.when(F.col("length") == F.col("own"), F.col("at")).otherwise(F.lit(0))
    met = materialize(with_next.withColumn("block", F.explode(F.sequence(start, F.col("blocks") - 1))).select(
        "own", "at", "length", "block"), "pairs")
    left = blocks.select(F.col("length").alias("own"), F.col("block").alias("at"), F.col("words").alias("left"))
    pairs = met.join(left, ["own", "at"]).join(blocks.withColumnRenamed("words", "right"), ["length", "block"])
    # Little data, much arithmetic: as many tasks as there is work for, however few bytes it is.
    tasks = max(1, -(-met.count() // TASK_PAIRS))
    return pairs.repartition(tasks, "own", "at", "length", "block").select(
        "left", "right", ((F.col("own") == F.col("length")) & (F.col("at") == F.col("block"))).alias("same"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches):
        for row in range(len(batch)):
            (left, a), (right, b) = (_unpacked(batch.column(side)[row]) for side in (0, 1))
            rows, cols = near_pairs(left, right)
            yield _best(rows, cols, len(left), right, b, left)
            if not batch.column(2)[row].as_py():
                yield _best(cols, rows, len(right), left, a, right)


def _unpacked(block: pa.ListScalar) -> tuple[list[str], np.ndarray]:
    values = block.values
    return values.field("word").to_pylist(), values.field("n").to_numpy(zero_copy_only=False)


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per row of `words` (word, n; each word once).

    Near words differ by one inserted, deleted or replaced code point. `form` is the near word with the largest
    n, the smallest in code-point order on a tie, if its n is at least `ratio` times the word's; else null.
    `root` is where following forms ends, the word itself without one. Null and empty words are left out, and
    an empty table has no result. Blocks hold a fixed number of code points, so a task's memory is fixed; what
    it returns is one row per word that has a near word there.
    """
    words = words.filter(F.length("word") > 0).select("word", "n")
    partial = _tiles(words).mapInArrow(_compare, "word string, n_near long, near_n long, near string")
    near = partial.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best_n = -F.col("best.less")
    joined = words.join(near, "word", "left").withColumn("follows", F.coalesce(best_n >= F.lit(ratio) * F.col("n"), F.lit(False)))
    formed = materialize(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("follows"), F.col("best.near")).alias("form"), F.when(F.col("follows"), best_n).alias("form_n")), "forms")
    return formed.join(_roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words with a form. Each round doubles the steps taken; n grows with every step, so there is an end."""
    steps = formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = materialize(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not steps.filter("moved").limit(1).count():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def spelling_variants(
    docs: DataFrame, lose: int | None = None, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, *,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """group_variants of the words with `least` or more occurrences; see word_counts for rows, nulls and columns."""
    counted = word_counts(docs, lose, shortest, key=key, text=text).filter(F.col("n") >= least)
    return group_variants(materialize(counted, "words"), ratio)
