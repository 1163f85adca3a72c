"""Likelihood of texts under a unigram model of subword pieces.

The pieces are those of an existing vocabulary file; their probabilities come
from how often the file's own segmentation uses them in the training texts. A
text has many segmentations; its probability is the sum over all of them, by a
forward recursion in log space over the bytes. Pieces hold no white space and a
marker starts each word, so the sum over a text factors into its words: each
distinct word is worked on once, and the corpus table of words is joined back.

The most frequent words, a bounded number, go to every task; only rarer ones are
joined, so no join key is frequent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log, log1p, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .parts import lean

FOLDS, HELD_OUT = 5, 1
SMOOTHING = 0.5
FREQUENT = 1 << 17  # words every task gets, with two numbers each
FLUSH = 400_000  # distinct words a task counts before it hands them on
MARK = "▁"  # starts a word in the vocabulary file
ROWS = 20_000
LN10 = log(10.0)


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words end at space and 0x09-0x0D."""
    return text.lower().split()


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """Documents kept from learning: crc32 of the key as text, mod `folds`, is 1. A null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == HELD_OUT, F.lit(False))


# --- Pieces ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Pieces:
    """Log probabilities (natural) of pieces that start a word, of those inside, and of the end of a text."""

    initial: dict[bytes, float]
    inner: dict[bytes, float]
    bare: float  # the marker alone
    end: float


def _piece_list(path: str) -> list[tuple[int, bytes, bool]]:
    """(id, bytes, starts a word) of the pieces a text can hold."""
    import sentencepiece

    library, found = sentencepiece.SentencePieceProcessor(model_file=path), []
    for at in range(library.get_piece_size()):
        piece = library.id_to_piece(at)
        if library.is_byte(at):
            found.append((at, bytes([int(piece[3:5], 16)]), False))
        elif not (library.is_control(at) or library.is_unknown(at) or library.is_unused(at)):
            starts = piece.startswith(MARK)
            rest = piece[1:] if starts else piece
            if MARK not in rest:
                found.append((at, rest.encode(), starts))
    return found


def learn_pieces(words: DataFrame, texts: int, path: str) -> Pieces:
    """Piece probabilities from (word, seen) rows and the number of training texts.

    One row per piece comes to the driver. Every piece, and the end, has half a
    count more than was seen; every byte is a piece, so no text is impossible.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        total = np.zeros(library.get_piece_size(), np.int64)
        for batch in lean(batches):
            seen = batch.column(1).to_pylist()
            for ids, n in zip(library.encode(batch.column(0).to_pylist(), num_threads=1), seen):
                for at in ids:
                    total[at] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["piece", "n"])

    rows = words.filter("seen > 0").select("word", "seen").mapInArrow(count, "piece long, n long")
    seen = {row["piece"]: row["n"] for row in rows.groupBy("piece").agg(F.sum("n").alias("n")).toLocalIterator()}
    pieces = _piece_list(path)
    weights = [seen.get(at, 0) + SMOOTHING for at, _, _ in pieces]
    total = sum(weights) + texts + SMOOTHING
    initial: dict[bytes, float] = {}
    inner: dict[bytes, float] = {}
    for (_, data, starts), weight in zip(pieces, weights):
        to = initial if starts else inner
        # A byte has a piece of its own beside the letter: two ways to write it.
        to[data] = log(exp(to[data]) + weight / total) if data in to else log(weight / total)
    bare = initial.pop(b"", None)
    if bare is None:
        raise ValueError("the vocabulary has no word marker")
    return Pieces(initial, inner, bare, log((texts + SMOOTHING) / total))


class Lattice:
    """Forward recursion over one word."""

    def __init__(self, pieces: Pieces):
        self.initial, self.inner, self.bare = _tree(pieces.initial), _tree(pieces.inner), pieces.bare

    def word(self, data: bytes) -> float:
        """Natural log of the summed probability of all ways to write a word, marker included."""
        n = len(data)
        ahead: list[float | None] = [None] * (n + 1)
        ahead[0] = self.bare
        self._extend(ahead, self.initial, data, 0, 0.0)
        for at in range(n):
            before = ahead[at]
            if before is not None:
                self._extend(ahead, self.inner, data, at, before)
        return ahead[n]

    @staticmethod
    def _extend(ahead: list, tree: dict, data: bytes, at: int, before: float) -> None:
        node = tree
        for to in range(at, len(data)):
            node = node.get(data[to])
            if node is None:
                return
            score = node.get(-1)
            if score is not None:
                score += before
                now = ahead[to + 1]
                if now is None:
                    ahead[to + 1] = score
                elif now < score:
                    ahead[to + 1] = score + log1p(exp(now - score))
                else:
                    ahead[to + 1] = now + log1p(exp(score - now))


def _tree(pieces: dict[bytes, float]) -> dict:
    """Nested dicts by byte; -1 holds the score of a piece that ends there."""
    root: dict = {}
    for data, score in pieces.items():
        node = root
        for byte in data:
            node = node.setdefault(byte, {})
        node[-1] = score
    return root


# --- Corpus -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    """`words`: (word, seen, uses, base, score), written once. Numbers: training tokens, types and texts."""

    words: DataFrame
    pieces: Pieces
    tokens: int
    types: int
    texts: int

    @property
    def base_total(self) -> float:
        """log10 of what every base count is divided by."""
        return log10(self.tokens + SMOOTHING * (self.types + 1))


def word_table(docs: DataFrame, *, train: str, text: str) -> DataFrame:
    """(word, seen, uses): how often a word is in training rows and in all rows of `docs`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            words = list(uses)
            return pa.RecordBatch.from_arrays([
                pa.array(words, pa.binary()).cast(pa.string()), pa.array([seen.get(w, 0) for w in words], pa.int64()),
                pa.array([uses[w] for w in words], pa.int64())], ["word", "seen", "uses"])

        seen, uses = Counter(), Counter()
        for batch in lean(batches):
            for learn, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(data or b"")
                uses.update(words)
                if learn:
                    seen.update(words)
                if len(uses) >= FLUSH:
                    yield rows()
                    seen, uses = Counter(), Counter()
        if uses:
            yield rows()

    counted = docs.select(train, text).mapInArrow(count, "word string, seen long, uses long")
    return counted.groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("uses").alias("uses"))


def fit(docs: DataFrame, path: str, *, train: str, text: str = "text") -> Model:
    """Learn from the rows of `docs` where the boolean column `train` holds; null texts are empty.

    The table also scores the words that only other rows hold, so `docs` are
    all texts that will be scored.
    """
    counted = materialize(word_table(docs, train=train, text=text), "words")
    totals = counted.agg(
        F.coalesce(F.sum("seen"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("seen") > 0, 1)).alias("types")).first()
    texts = docs.filter(train).count()
    pieces = learn_pieces(counted, texts, path)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        for batch in lean(batches):
            words = batch.column(0).cast(pa.binary()).to_pylist()
            base = np.log10(batch.column(1).to_numpy(zero_copy_only=False) + SMOOTHING)
            found = [lattice.word(w) / LN10 for w in words]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(base), pa.array(found, pa.float64())], ["word", "seen", "uses", "base", "score"])

    scored = counted.mapInArrow(score, "word string, seen long, uses long, base double, score double")
    # Every text ends with a token of its own, known once there is a training text.
    return Model(materialize(scored, "scores"), pieces, totals["tokens"] + texts, totals["types"] + (texts > 0), texts)


def score(docs: DataFrame, model: Model, *, by: list[str], text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(*by, n_tokens, n_known, base_score, score), one row per value of the columns `by` of `docs`.

    The first of `by` is a long that is never null. Words a model has not been
    fitted with raise an error. Texts are read once and never shuffled: what a
    document has of the `frequent` most used words is added up in its task, the
    rest goes out as one narrow row per distinct word.
    """
    spark = docs.sparkSession
    top = model.words.orderBy(F.desc("uses"), "word").limit(frequent).select("word", "seen", "base", "score")
    head = {row["word"].encode(): (row["seen"] > 0, row["base"], row["score"]) for row in top.toLocalIterator()}
    shared = spark.sparkContext.broadcast(head)
    width = len(by)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
        names = [*by, "n_tokens", "n_known", "base", "score", "word", "n"]

        def rows(batch: pa.RecordBatch, which: list[int], held: list[tuple]) -> pa.RecordBatch:
            at = pa.array(which, pa.int32())
            columns = [pa.array(c, k) for c, k in zip(zip(*held), kinds)]
            columns[4] = columns[4].cast(pa.string())
            return pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(width)), *columns], names)

        for batch in lean(batches):
            which, held = [], []
            for at, data in enumerate(batch.column(width).cast(pa.binary()).to_pylist()):
                words = words_of(data or b"")
                n_known, base, total, rest = 0, 0.0, 0.0, []
                for word, n in Counter(words).items():
                    found = known.get(word)
                    if found is None:
                        rest.append((None, None, None, None, word, n))
                    else:
                        n_known += n * found[0]
                        base += n * found[1]
                        total += n * found[2]
                held.append((len(words), n_known, base, total, None, None))
                held += rest
                which += [at] * (1 + len(rest))
                if len(held) >= ROWS:
                    yield rows(batch, which, held)
                    which, held = [], []
            if held:
                yield rows(batch, which, held)

    kept = [f for f in docs.select(*by).schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    out = docs.select(*by, text).mapInArrow(
        cut, f"{schema}, n_tokens long, n_known long, base double, score double, word string, n long")
    # A document's own row meets nothing; its key can't be a word, which has no space.
    keyed = out.withColumn("word", F.coalesce("word", F.concat(F.lit(" "), F.col(by[0]).cast("string"))))
    table = model.words.select("word", F.col("seen").alias("w_seen"), F.col("base").alias("w_base"), F.col("score").alias("w_score"))
    met = keyed.join(table, "word", "left")
    missing = F.when(F.col("n").isNotNull() & F.col("w_seen").isNull(), F.raise_error(F.lit("a word the model was not fitted with")))
    part = [
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", missing, F.when(F.col("w_seen") > 0, F.col("n")), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("base", F.col("n") * F.col("w_base"))).alias("base"),
        F.sum(F.coalesce("score", F.col("n") * F.col("w_score"))).alias("score"),
    ]
    summed = met.groupBy(*by).agg(*part)
    known_end = 1 if model.texts else 0
    tokens = F.col("n_tokens") + 1
    return summed.select(
        *by, tokens.alias("n_tokens"), (F.col("n_known") + known_end).alias("n_known"),
        (F.col("base") + log10(model.texts + SMOOTHING) - tokens * model.base_total).alias("base_score"),
        (F.col("score") + model.pieces.end / LN10).alias("score"))


def likelihood(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of `docs`.

    Learns from the rows that are not held out. A null text is empty: only its
    end is scored. `base_score` is the smoothed word unigram, `score` the log10
    probability of the text summed over all segmentations. Rows are told apart
    by their place in the scan, so repeated and null keys keep their own rows;
    without any row the result is empty. Other columns are not looked at.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"),
        held_out(F.col(key)).alias("held_out"), (~held_out(F.col(key))).alias("train"))
    model = fit(rows, path, train="train", text="text")
    found = score(rows, model, by=["row", "key", "held_out"], text="text")
    return found.select(
        F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score")
