"""Phrases that stand together, by multikey three-way quicksort of suffix pointers.

The suffix of a word is the word and up to three after it, within its piece of
text. Suffixes are routed to tasks by their leading words, up to the first that
is not frequent, so a frequent word, pair or triple is dealt to many tasks and
no route holds more suffixes than its last word has occurrences. A task sorts
pointers to its suffixes: a pivot parts them, by the word at one depth, into
less, equal and greater. Those that are equal are the occurrences of one phrase,
their number is its count, and they are parted again one word deeper; partitions
with too few occurrences are abandoned; a word that has too few itself ends the
suffixes it stands in before they are routed. Where all words of a phrase are frequent
its occurrences lie in several tasks, so nothing is abandoned there and the
counts are added up afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .parts import lean
from .scan import Texts, byte_set, numbered

MOST_WORDS = 4  # of a phrase
LEAST = 30  # occurrences of a phrase
INSIDE = (100, 80)  # a phrase goes if 100 times a longer one's count is 80 times its own or more
TOP = 2000
RANKED_APART = 64  # shares of a language that are ranked on their own first
SCORE = 2_000_000
UNKNOWN = "und"
BREAKS = ".,;:!?\n\x0b\x0c\r"
SPACES = " \t"
CHUNK_WORDS = 1 << 21  # words whose suffixes are sorted together before they are passed on
ROUTE_BYTES = 24 << 20  # of text for a route
COMMON_BITS = 1 << 25  # of the table that tells tasks which words can be in a phrase that counts
FREQUENT = (1 << 18, 1 << 16)  # occurrences of a frequent word: so many, or more than one in so many of all words

CODEC = "zstd"

NOT_BREAK, WORD = ~byte_set(BREAKS), ~byte_set(BREAKS + SPACES)


# --- Words --------------------------------------------------------------------------------

def _words(column: pa.Array) -> tuple[Texts, np.ndarray, np.ndarray, pa.Array]:
    """(texts, text of each word, whether a piece begins with it, the words)."""
    texts = Texts(column)
    inside = WORD[texts.data]
    starts, ends = texts.runs(inside)
    begun = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(~NOT_BREAK[texts.data], out=begun[1:])
    piece, row = begun[starts], texts.rows(starts)
    new = np.ones(len(starts), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    return texts, row, new, texts.words(starts, ends, inside)


def _lang_numbers(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of rows (lang, text); added up within an Arrow batch, then by a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            _, row, _, words = _words(batch.column(1))
            which, distinct = numbered(words)
            at, langs = _lang_numbers(batch.column(0))
            pairs, n = np.unique(at[row].astype(np.int64) * len(distinct) + which, return_counts=True)
            lang = pa.array(langs, pa.string()).take(pa.array(pairs // max(1, len(distinct))))
            word = distinct.take(pa.array(pairs % max(1, len(distinct)))).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang, word, pa.array(n)], ["lang", "word", "n"])

    return rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


# --- Routing --------------------------------------------------------------------------------

class _Chunk:
    """Words of several batches; their suffixes go out sorted, equal ones as one with their number."""

    def __init__(self, routes: int, frequent: dict[str, set[bytes]], common: np.ndarray):
        self.routes, self.frequent, self.common = routes, frequent, common
        self.clear()

    def clear(self) -> None:
        self.words, self.langs, self.new, self.size = [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        _, row, new, words = _words(batch.column(1))
        at, names = _lang_numbers(batch.column(0))
        self.words.append(words)
        self.langs.append(np.array(names, object)[at[row]] if len(row) else np.array([], object))
        self.new.append(new)
        self.size += len(words)

    def routed(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        which, distinct = numbered(pa.chunked_array(self.words).combine_chunks())
        # In order, so that neighbours have much in common and words as well as numbers pack well.
        order = pa.compute.sort_indices(distinct)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        which, distinct = place[which], distinct.take(order)
        langs, new = np.concatenate(self.langs), np.concatenate(self.new)
        spelt = distinct.to_pylist()
        hashes = np.array([0, *map(crc32, spelt)], np.uint64)
        for lang in sorted(set(langs.tolist())):
            mine = langs == lang
            frequent = self.frequent.get(lang, set())
            hot = np.array([False, *[word in frequent for word in spelt]])
            begun = crc32(_begin(lang))
            common = self.common[np.array([0, *[crc32(word, begun) % COMMON_BITS for word in spelt]])]
            yield from self._of_lang(lang, which[mine] + 1, new[mine], hashes, hot, common, distinct)
        self.clear()

    def _of_lang(self, lang, ids, new, hashes, hot, common, distinct) -> Iterator[pa.RecordBatch]:
        suffixes = np.zeros((len(ids), MOST_WORDS), np.int32)
        suffixes[:, 0] = ids
        stays = common[ids]  # what holds another word is in no phrase that counts
        along = stays  # the suffix still runs on
        for depth in range(1, MOST_WORDS):
            along = along[:-1] & ~new[depth:] & stays[depth:]
            suffixes[:-depth, depth][along] = ids[depth:][along]
        suffixes, times = _distinct_rows(suffixes[suffixes[:, 1] > 0])
        route, further = hashes[suffixes[:, 0]], hot[suffixes[:, 0]]
        for depth in range(1, MOST_WORDS):
            word = suffixes[:, depth]
            further = further & (word > 0)
            route = np.where(further, route * np.uint64(0x9E3779B97F4A7C15) + hashes[word], route)
            further = further & hot[word]
        route = ((route ^ (route >> np.uint64(29))) % np.uint64(self.routes)).astype(np.int64)
        order = np.argsort(route.astype(np.min_scalar_type(self.routes)), kind="stable")
        suffixes, times, route = suffixes[order], times[order], route[order]
        edges = np.flatnonzero(np.diff(route)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(route)]):
            if end > start:
                yield _packed(lang, int(route[start]), suffixes[start:end], times[start:end], distinct)


def _distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and how often each occurs."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    bits = int(rows.max()).bit_length()
    if bits * MOST_WORDS <= 63:
        keys = np.zeros(len(rows), np.int64)
        for depth in range(MOST_WORDS):
            keys <<= bits
            keys |= rows[:, depth]
        keys, times = np.unique(keys, return_counts=True)
        shifts = bits * np.arange(MOST_WORDS - 1, -1, -1)
        return (keys[:, None] >> shifts & ((1 << bits) - 1)).astype(rows.dtype), times
    rows = rows[np.lexsort(rows.T[::-1])]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
    return rows[first], np.diff(np.r_[first, len(rows)])


def _packed(lang: str, route: int, suffixes: np.ndarray, times: np.ndarray, distinct: pa.Array) -> pa.RecordBatch:
    """One row: the words of some suffixes, and the suffixes as numbers of them, column by column."""
    number = np.zeros(len(distinct) + 1, "<u4")  # 0 stands for no word
    number[suffixes.reshape(-1)] = 1
    number[0] = 0
    used = np.flatnonzero(number)
    number[used] = np.arange(1, len(used) + 1)
    words = b" ".join(distinct.take(pa.array(used - 1)).to_pylist())
    body = _planes(number[suffixes].T) + _planes(times.astype("<u4"))
    return pa.RecordBatch.from_arrays([
        pa.array([lang]), pa.array([route]), pa.array([len(times)], pa.int32()), pa.array([len(words)], pa.int32()),
        pa.array([pa.compress(words, codec=CODEC, asbytes=True)], pa.binary()), pa.array([pa.compress(body, codec=CODEC, asbytes=True)], pa.binary()),
    ], ["lang", "route", "size", "length", "words", "suffixes"])


def _planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: small numbers leave long runs of zeros."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(size: int, length: int, words: pa.Scalar, suffixes: pa.Scalar) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, a row of numbers of them per suffix, times)."""
    spelt = pa.decompress(words.as_buffer(), decompressed_size=length, codec=CODEC, asbytes=True).split(b" ")
    body = pa.decompress(suffixes.as_buffer(), decompressed_size=4 * size * (MOST_WORDS + 1), codec=CODEC, asbytes=True)
    columns, times = body[:4 * size * MOST_WORDS], body[4 * size * MOST_WORDS:]

    def numbers(planes: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)

    return spelt, numbers(columns).reshape(MOST_WORDS, size).T.astype(np.int32), numbers(times).astype(np.int64)


# --- Sorting --------------------------------------------------------------------------------

def three_way(
    suffixes: np.ndarray, times: np.ndarray, hot: np.ndarray, least: int,
) -> Iterator[tuple[tuple[int, ...], int]]:
    """(phrase, count) of the phrases of two words or more with `least` occurrences, by three-way quicksort.

    `suffixes` has a row of word numbers for each suffix, 0 after its end, and `times` its occurrences. Where all
    words so far are `hot`, suffixes that begin with them are elsewhere too: what is found is passed on however
    few they are.
    """
    columns = [np.ascontiguousarray(suffixes[:, depth]) for depth in range(suffixes.shape[1])]
    deepest = len(columns)
    # (pointers, depth, phrase so far, whether a word at this depth may be frequent and its partition incomplete)
    pending = [(np.arange(len(times)), 0, (), True)]
    while pending:
        pointers, depth, phrase, loose = pending.pop()
        here = columns[depth][pointers]
        if loose and depth + 1 < deepest:
            spread = hot[here]
            if not spread.all():
                pending.append((pointers[~spread], depth, phrase, False))
            pointers, here = pointers[spread], here[spread]
            if not len(pointers):
                continue
        complete = not loose or depth + 1 == deepest
        if complete and times[pointers].sum() < least:
            continue
        pivot = int(here[len(here) // 2])
        same = here == pivot
        for part in (here < pivot, here > pivot):
            if part.any():
                pending.append((pointers[part], depth, phrase, loose))
        if pivot == 0:
            continue
        equal = pointers[same]
        count = int(times[equal].sum())
        if complete and count < least:
            continue
        if depth:
            yield (*phrase, pivot), count
        if depth + 1 < deepest:
            pending.append((equal, depth + 1, (*phrase, pivot), not complete))


def _counted(frequent: dict[str, set[bytes]], least: int):
    def sort(route: pa.Table) -> pa.Table:
        lang = route["lang"][0].as_py()
        known_as: dict[bytes, int] = {}
        blocks, times = [], []
        for row in zip(route["size"].to_pylist(), route["length"].to_pylist(), route["words"], route["suffixes"]):
            words, suffixes, n = _unpacked(*row)
            place = np.array([0, *[known_as.setdefault(word, len(known_as) + 1) for word in words]], np.int32)
            blocks.append(place[suffixes])
            times.append(n)
        spelt = list(known_as)
        known = frequent.get(lang, set())
        hot = np.array([False, *[word in known for word in spelt]])
        found = list(three_way(np.concatenate(blocks), np.concatenate(times), hot, least))
        phrases = [b" ".join([spelt[w - 1] for w in phrase]).decode() for phrase, _ in found]
        return pa.table([
            pa.array([lang] * len(found), pa.string()), pa.array(phrases, pa.string()), pa.array([n for _, n in found], pa.int64())],
            ["lang", "phrase", "f"])

    return sort


def _begin(lang: str) -> bytes:
    return f"{lang}\0".encode()


def common_words(words: DataFrame, least: int) -> np.ndarray:
    """A table of COMMON_BITS bits that is true where a word of `least` occurrences or more falls, by crc32 of language and word.

    Of a fixed size: the more frequent words there are, the more others pass for one.
    """
    place = F.pmod(F.crc32(F.concat("lang", F.lit("\0"), "word")), F.lit(COMMON_BITS)) + 1
    blocks = words.filter(F.col("n") >= least).select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    table = np.zeros(COMMON_BITS, bool)
    for row in blocks.toLocalIterator():
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        table[(row["block"] - 1) * len(bits):row["block"] * len(bits)] = bits
    return table


def phrase_counts(rows: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, f) of all phrases of 2 to MOST_WORDS words with `least` occurrences in rows (lang, text).

    `words` is what word_counts gives. The frequent words that routes go by come to the driver: at most FREQUENT[1] of them.
    """
    told = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    routes = max(1, -(-told["size"] // ROUTE_BYTES))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    frequent: dict[str, set[bytes]] = {}
    for row in words.filter(F.col("n") > max(FREQUENT[0], total // FREQUENT[1])).toLocalIterator():
        frequent.setdefault(row["lang"], set()).add(row["word"].encode())

    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(common_words(words, least)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(routes, frequent, np.unpackbits(shared.value).view(bool))
        for batch in lean(batches):
            chunk.add(batch)
            if chunk.size >= CHUNK_WORDS:
                yield from chunk.routed()
        yield from chunk.routed()

    routed = rows.mapInArrow(route, "lang string, route long, size int, length int, words binary, suffixes binary")
    found = routed.groupBy("lang", "route").applyInArrow(_counted(frequent, least), "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


# --- Scores ---------------------------------------------------------------------------------

def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, *, text: str = "text", lang: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases by how firmly their words stand together.

    A-Z in lower case; texts are cut at BREAKS into pieces, pieces at spaces and tabs into words. A phrase of 2
    to 4 words has a occurrences, overlaps included, `least` at least; cut after k words, its parts have l and
    r, and its score is the lowest of floor(SCORE * a / (l + r)) over its cuts, the smallest k on a tie. Phrases
    inside a longer one with at least 80 % of their count go. n counts all words of the language. Ranked by
    score, a, then the phrase in byte order. A null language is `und`, a null text empty; repeated rows count
    again; other columns are not looked at; an empty table has no result. Counts are decimal where they are
    multiplied, so nothing overflows.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    words = materialize(word_counts(rows), "words")
    phrases = materialize(phrase_counts(rows, words, least), "phrases")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = words.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")).unionByName(phrases)
    split = F.split("phrase", " ")

    def joined(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    size = F.size("w")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), split.alias("w")).withColumn(
        "k", F.explode(F.sequence(F.lit(1), size - 1)))
    sides = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, size - F.col("k")).alias("rest"))
    first, rest = (parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)) for part, name in (("first", "l"), ("rest", "r")))
    wide = "decimal(20,0)"
    score = F.expr(f"CAST({SCORE} AS DECIMAL(10,0)) * CAST(a AS {wide}) DIV (CAST(l AS {wide}) + CAST(r AS {wide}))")
    scored = sides.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    # All shorter phrases of each phrase, with the largest count of a longer one that holds them.
    spans = [(i, n) for n in range(2, MOST_WORDS) for i in range(1, MOST_WORDS - n + 2)]
    longer = phrases.select("lang", F.col("f").alias("longer"), split.alias("w")).filter(size > 2)
    held = longer.select("lang", "longer", F.explode(F.array_distinct(F.filter(F.array(*[
        F.when(size >= F.lit(i + n - 1), F.when(size > F.lit(n), joined(F.lit(i), F.lit(n)))) for i, n in spans]), lambda p: p.isNotNull()))).alias("phrase"))
    covers = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    times, share = INSIDE
    covered = F.lit(times).cast("decimal(10,0)") * F.col("longer").cast(wide) >= F.lit(share).cast("decimal(10,0)") * F.col("a").cast(wide)
    kept = scored.join(covers, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False)))
    # Each language is dealt to several tasks, which keep the best of their own.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(dealt)).filter(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
