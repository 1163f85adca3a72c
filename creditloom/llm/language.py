"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An
n-gram binds its letters: the vector of the letter k places from the end is
rotated k times, and the rotated vectors are multiplied. A text bundles (adds)
its n-grams, a language the n-grams of its texts; the language whose prototype
has the largest cosine with the text is predicted.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parts import lean, slices
from .simhash import unused

WIDTH = 1024  # length of the vectors
GRAM = 3
SEED = 7
UNKNOWN = "und"
FOLDS, HELD_OUT = 3, 1
BATCH_CHARS = 1 << 19  # characters bundled together; a longer text is taken in pieces
BATCH_DOCS = 128
BLOCK = 4096  # n-grams whose vectors are in memory at a time
LETTERS_HELD = 1 << 15  # vectors of letters remembered, beside those of a block
CONTEXT = 64  # characters around a cut
DENSE = 1 << 22  # codes numbered by a plain table; more are sorted

PREDICTION = "lang_pred string, score double"


@dataclass
class Counts:
    """N-grams of some texts: (text, n-gram, times) without zeros, the n-grams as rows of code points, and letters per text."""

    text: np.ndarray
    gram: np.ndarray
    times: np.ndarray
    rows: np.ndarray
    letters: np.ndarray


class Grams:
    """Turns texts into counts of n-grams, and n-grams into vectors."""

    def __init__(self, width: int = WIDTH, gram: int = GRAM, seed: int = SEED):
        self.width, self.gram, self.seed = width, gram, seed
        self.place: dict[int, int] = {}  # of a letter's vector in the table
        self.table = np.zeros((256, width), np.int8)
        kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
        self.is_letter, self.in_word = (np.fromiter((k in wanted for k in kinds), bool, len(kinds)) for wanted in ("L", "LM"))

    def letter(self, code: int) -> np.ndarray:
        bits = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 2, self.width, dtype=np.int8)
        return 2 * bits - 1

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Where the vectors of these letters lie in the table; those that are new are drawn."""
        new = [c for c in codes.tolist() if c not in self.place]
        if len(self.place) + len(new) > LETTERS_HELD:
            self.place.clear()
            new = codes.tolist()
        held, needed = len(self.place), len(self.place) + len(new)
        if needed > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((2 * needed - len(self.table), self.width), np.int8)])
        for at, c in enumerate(new, held):
            self.table[at] = self.letter(c)
            self.place[c] = at
        return np.array([self.place[c] for c in codes.tolist()], np.int64)

    def counts(self, texts: Sequence[str]) -> Counts:
        """A run of anything but letters and their marks is one space; a text starts and ends with one."""
        codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        lengths = np.array([len(c) for c in codes], np.int64) + 2
        ends = np.cumsum(lengths)
        flat = np.full(int(ends[-1]) if len(ends) else 0, 32, np.int32)
        for end, c in zip(ends, codes):
            flat[end - 1 - len(c):end - 1] = c
        text = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        letters = np.bincount(text[self.is_letter[flat]], minlength=len(texts))
        flat[~self.in_word[flat]] = 32
        first = np.ones(len(flat), bool)
        first[1:] = (flat[1:] != 32) | (flat[:-1] != 32) | (text[1:] != text[:-1])
        return self._counted(flat[first], text[first], letters)

    def _counted(self, flat: np.ndarray, text: np.ndarray, letters: np.ndarray) -> Counts:
        """Of letters that follow each other within a text."""
        size = self.gram
        n = len(flat) - size + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return Counts(none, none, none, np.zeros((0, size), np.int64), letters)
        alphabet, place = _distinct(flat)
        code = np.zeros(n, np.int64)
        for at in range(size):
            code *= len(alphabet)
            code += place[at:at + n]
        whole = text[:n] == text[size - 1:]
        every = len(alphabet) ** size
        pairs = text[:n][whole] * np.int64(every) + code[whole]
        pairs.sort()
        begins = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else none
        times = np.diff(np.r_[begins, len(pairs)])
        which, code = np.divmod(pairs[begins], every)
        used, code = _distinct(code)
        rows = np.empty((len(used), size), np.int64)
        for at in range(size - 1, -1, -1):
            rows[:, at] = alphabet[used % len(alphabet)]
            used = used // len(alphabet)
        return Counts(which, code, times, rows, letters)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """The bound vector of every n-gram."""
        out = np.ones((len(rows), self.width), np.int8)
        for at in range(self.gram):
            alphabet, place = np.unique(rows[:, at], return_inverse=True)
            held = self.places(alphabet)
            out *= np.roll(self.table[held[place]], self.gram - 1 - at, axis=1)
        return out.astype(np.float32)

    def bundled(self, counts: Counts, group: np.ndarray, groups: int) -> np.ndarray:
        """A vector per group of texts. N-grams are taken BLOCK at a time, so memory does not follow their number."""
        out = np.zeros((groups, self.width))
        order = np.argsort(counts.gram, kind="stable")
        gram, times, to = counts.gram[order], counts.times[order], group[counts.text[order]]
        for start in range(0, len(counts.rows), BLOCK):
            part = slice(*np.searchsorted(gram, [start, start + BLOCK]))
            rows = counts.rows[start:start + BLOCK]
            dense = np.bincount(to[part] * len(rows) + gram[part] - start, times[part], groups * len(rows)).reshape(groups, len(rows))
            out += dense.astype(np.float32) @ self.vectors(rows)
        return out

    def bundles(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(a vector per text, letters per text)."""
        counts = self.counts(texts)
        return self.bundled(counts, np.arange(len(texts)), len(texts)), counts.letters

    def long_bundle(self, text: str) -> tuple[np.ndarray, int]:
        """`bundles` of one text, piece by piece: a piece goes on from the last letters of the one before."""
        total, letters, last = np.zeros(self.width), 0, np.array([32], np.int32)
        for start in range(0, len(text) + 1, BATCH_CHARS):
            # Case may depend on neighbours: a word is lowered with those around the cut.
            piece = text[max(0, start - CONTEXT):start + BATCH_CHARS + CONTEXT]
            lowered = _lowered(piece, min(start, CONTEXT), min(BATCH_CHARS, len(text) - start))
            codes = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
            letters += int(self.is_letter[codes].sum())
            codes[~self.in_word[codes]] = 32
            if start + BATCH_CHARS > len(text):
                codes = np.r_[codes, 32]
            flat = np.r_[last, codes].astype(np.int32)
            kept = np.ones(len(flat), bool)
            kept[1:] = (flat[1:] != 32) | (flat[:-1] != 32)
            flat = flat[kept]
            counts = self._counted(flat, np.zeros(len(flat), np.int32), np.zeros(1))
            total += self.bundled(counts, np.zeros(1, np.int64), 1)[0]
            last = flat[-(self.gram - 1):] if self.gram > 1 else flat[:0]
        return total, letters


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different values in order, the place of each)."""
    if len(codes) and codes.max() < DENSE:
        used = np.flatnonzero(np.bincount(codes))
        place = np.zeros(int(used[-1]) + 1, np.int64)
        place[used] = np.arange(len(used))
        return used, place[codes]
    return np.unique(codes, return_inverse=True)


def _lowered(piece: str, before: int, size: int) -> str:
    """Lower case of `size` characters of a piece that has `before` others in front."""
    head, own = piece[:before], piece[before:before + size]
    return piece.lower()[len(head.lower()):len(head.lower()) + len(own.lower())]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and end - start < BATCH_DOCS and (end == start or chars + len(texts[end]) <= BATCH_CHARS):
            chars += len(texts[end])
            end += 1
        yield texts[start:end]
        start = end


def _bundles(grams: Grams, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    if len(texts) == 1 and len(texts[0]) > BATCH_CHARS:
        vector, letters = grams.long_bundle(texts[0])
        return vector[None, :], np.array([letters])
    return grams.bundles(texts)


@dataclass(frozen=True)
class Profiles:
    """Language prototypes: as many rows as there are languages."""

    languages: list[str]
    prototypes: np.ndarray
    gram: int = GRAM
    seed: int = SEED


def learn(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", width: int = WIDTH, gram: int = GRAM, seed: int = SEED,
) -> Profiles:
    """Prototypes from all rows with text and language.

    Each task adds up the vectors of its rows per language; those sums are added
    by a shuffle of languages x width numbers per task. Only the prototypes come
    to the driver. Rows with a null text or language teach nothing; an empty
    table gives no language.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(width, gram, seed), {}

        def add(name: str, total: np.ndarray) -> None:
            sums[name] = sums.get(name, 0.0) + total

        for batch in lean(batches):
            languages, at = batch.column(1).to_pylist(), 0
            for texts in (part for some in slices(batch.column(0)) for part in _slices(some)):
                mine = languages[at:at + len(texts)]
                at += len(texts)
                if len(texts) == 1 and len(texts[0]) > BATCH_CHARS:
                    add(mine[0], grams.long_bundle(texts[0])[0])
                    continue
                names, which = np.unique(np.array(mine, object).astype(str), return_inverse=True)
                for name, total in zip(names.tolist(), grams.bundled(grams.counts(texts), which, len(names))):
                    add(name, total)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * width), pa.array(range(width), pa.int32()), pa.array(total)], ["lang", "at", "value"])

    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang).cast("string"))
    sums = rows.mapInArrow(bundle, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for row in sums.toLocalIterator():
        found.setdefault(row["lang"], np.zeros(width))[row["at"]] = row["value"]
    names = sorted(found)
    return Profiles(names, np.array([found[n] for n in names]).reshape(len(names), width), gram, seed)


def predict(text: Column, profiles: Profiles) -> Column:
    """struct(lang_pred, score) of a text column: the nearest language and its cosine, cut to 0..1.

    A null text, or one without a letter, is `und` with score 0, as is any text
    if no language was learnt. Of equal cosines the first language by name wins.
    """

    @F.arrow_udf(PREDICTION)
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        width = profiles.prototypes.shape[1]
        grams = Grams(width, profiles.gram, profiles.seed)
        lengths = np.linalg.norm(profiles.prototypes, axis=1, keepdims=True)
        unit = (profiles.prototypes / np.where(lengths == 0, 1, lengths)).astype(np.float64)
        for batch in lean(batches):
            names, scores = [], []
            for texts in (part for some in slices(batch) for part in _slices([t or "" for t in some])):
                bundled, letters = _bundles(grams, texts)
                if not len(unit):
                    names += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                norm = np.linalg.norm(bundled, axis=1)
                cosine = bundled @ unit.T / np.where(norm == 0, 1, norm)[:, None]
                best = np.round(cosine, 12).argmax(axis=1)  # equal cosines may differ in their last digit
                for row, (at, n) in enumerate(zip(best.tolist(), letters.tolist())):
                    names.append(profiles.languages[at] if n else UNKNOWN)
                    scores.append(min(1.0, max(0.0, float(cosine[row, at]))) if n else 0.0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return nearest(text)


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """Documents kept from learning: crc32 of the key as text, mod `folds`, is 1. A null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == HELD_OUT, F.lit(False))


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score), one row per row of `docs`.

    Learns from the rows that are not held out, predicts all from their text
    alone. Repeated rows give repeated results; other columns are not looked at.
    Two scans, no shuffle of texts.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    profiles = learn(rows.filter(~held_out(F.col("key"))))
    return rows.select(
        F.col("key").alias(key), held_out(F.col("key")).alias("held_out"),
        predict(F.col("text"), profiles).alias("_p")).select(key, "held_out", "_p.lang_pred", "_p.score")


def keep_identified(
    docs: DataFrame, least: float = 0.0, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """The rows of `docs` with an identified language and a score of `least` or more; columns as they were."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    profiles = learn(rows.filter(~held_out(F.col("key"))))
    found = unused(docs, "found")
    told = docs.withColumn(found, predict(F.col(text), profiles))
    return told.filter((F.col(found)["lang_pred"] != UNKNOWN) & (F.col(found)["score"] >= least)).select(*docs.columns)
