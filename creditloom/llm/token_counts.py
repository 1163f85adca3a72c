"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a pre-token are a doubly linked list; a heap holds the rank and
place of every adjacent pair. The lowest rank, leftmost first, is merged until
no pair is left; stale heap entries are skipped when they surface. The count is
the number of initial symbols minus the number of merges: no identifiers leave
the loop. n symbols take n log n steps, so a text without spaces is no trap.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parts import LONGEST, REMEMBERED, SLICE_CHARS, Cutter, PieceCache, in_slices, lean, slices

LIMIT = 1024


class MergeCounter:
    """Counts tokens with the merge ranks of a byte-level tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.split = self.library.pre_tokenizer.pre_tokenize_str
        vocabulary = described["model"]["vocab"]
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in described["model"]["merges"]]
        self.symbol = {piece: at for piece, at in vocabulary.items() if len(piece) == 1}
        self.rank = {(vocabulary[a], vocabulary[b]): at for at, (a, b) in enumerate(pairs)}
        self.merged = [vocabulary[a + b] for a, b in pairs]
        self.special = [token["content"] for token in described["added_tokens"]]
        kinds = [described.get("normalizer"), (described.get("pre_tokenizer") or {}).get("type")]
        odd = any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in described["added_tokens"])
        if kinds != [None, "ByteLevel"] or odd or not described["pre_tokenizer"].get("use_regex", True) or described["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level tokenizers without a normalizer are supported")
        self.remembered: dict[str, int] = {}
        self.cutter = Cutter(self.special)
        self.pieces = PieceCache(self.cutter, lambda pieces: list(map(self.merge, pieces)), lambda texts: list(map(self.tokens, texts)))

    def merge(self, piece: str) -> int:
        """Tokens of one pre-token, given in the printable characters that stand for its bytes."""
        count = size = len(piece)
        if count < 2:
            return count
        rank, merged, bits = self.rank.get, self.merged, size.bit_length()
        symbol = [self.symbol[c] for c in piece]
        ranks = [*map(rank, zip(symbol, symbol[1:])), None]  # of each symbol with the next
        heap = [r << bits | at for at, r in enumerate(ranks) if r is not None]
        heapify(heap)
        following, previous, places = list(range(1, size + 1)), list(range(-1, size - 1)), (1 << bits) - 1
        while heap:
            entry = heappop(heap)
            r, at = entry >> bits, entry & places
            if ranks[at] != r:
                continue  # a neighbour has been merged since
            right, before = following[at], previous[at]
            after = following[at] = following[right]
            symbol[at], ranks[right], ranks[at] = merged[r], None, None
            count -= 1
            if after < size:
                previous[after] = at
                r = ranks[at] = rank((symbol[at], symbol[after]))
                if r is not None:
                    heappush(heap, r << bits | at)
            if before >= 0:
                r = ranks[before] = rank((symbol[before], symbol[at]))
                if r is not None:
                    heappush(heap, r << bits | before)
        return count

    def count(self, piece: str) -> int:
        """Tokens of a pre-token, remembered."""
        n = self.remembered.get(piece)
        if n is None:
            n = self.merge(piece)
            if len(piece) <= LONGEST:
                if len(self.remembered) >= REMEMBERED:
                    self.remembered.clear()
                self.remembered[piece] = n
        return n

    def tokens(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token, as the library has it."""
        segments, total = [text], 0
        for special in self.special:
            if special in text:
                total += sum(segment.count(special) for segment in segments)
                segments = [piece for segment in segments for piece in segment.split(special)]
        return total + sum(self.count(piece) for segment in segments if segment for piece, _ in self.split(segment))

    def counts(self, texts: Sequence[str]) -> list[int]:
        found = []
        for some in in_slices(texts, SLICE_CHARS):
            cut = self.cutter.cut(some)
            values, loose = self.pieces.results(cut.pieces)
            before = np.cumsum([0, *np.array([n or 0 for n in values], np.int64)[cut.number]])[cut.first]
            found += [self.tokens(text) if whole else n for text, whole, n in zip(some, cut.whole(loose), np.diff(before).tolist())]
        return found


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text column, a long; a null text counts as empty."""

    @F.arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = MergeCounter(path)
        for batch in lean(batches):
            found = [n for texts in slices(batch) for n in counter.counts([text or "" for text in texts])]
            yield pa.array(found, pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit), one row per row of `docs`.

    Counts equal those of the tokenizer file at `path` without added tokens. A
    null or empty text has 0 bytes and 0 tokens; a null key stays null; repeated
    rows give repeated results; other columns are not looked at. Row by row: no
    shuffle, and memory is bounded by the longest text.
    """
    counted = docs.select(
        F.col(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col(text), path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
