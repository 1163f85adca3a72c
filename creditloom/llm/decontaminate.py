"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest k-gram hashes of each run of w k-grams.
With k + w - 1 = SPAN words, two texts that share SPAN words in a row share a
fingerprint, so no shared span of that length is missed. The benchmark's
fingerprints are folded into a bitmap of fixed size that every task gets; a
document fingerprint found in it is a hit, and the spans of SPAN words around
the hit are its extensions. Those are joined with the benchmark's spans on their
words, which settles what a fingerprint only suggests. Benchmark items shorter
than SPAN are spans of their own length; there every gram is a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .parts import lean
from .simhash import unused

SPAN = 13  # words in a row
GRAM = 7  # words of a k-gram
BITMAP_BITS = 1 << 23  # 1 MB for every task, whatever the size of the benchmark
SPAN_ROWS = 10_000  # rows of an Arrow batch of spans
SHARE = 20  # contaminated: a twentieth of the words or more

# Words are runs of digits, letters and everything beyond ASCII; A-Z is lower-cased.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def gram_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of every `size` words in a row."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for at in range(size):
        out = (out ^ each[at:at + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash, the last of equals, in every `window` hashes in a row."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, place = hashes[:n].copy(), np.arange(n)
    for at in range(1, window):
        other = hashes[at:at + n]
        better = other <= best
        best = np.where(better, other, best)
        place = np.where(better, np.arange(at, at + n), place)
    return np.unique(place)


def fingerprints(words: list[bytes], length: int, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, places, words per gram) that stand for the spans of `length` words."""
    size = gram if length == span else length
    hashes = gram_hashes(words, size)
    places = winnow(hashes, length - size + 1)
    return hashes[places], places, size


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes & np.uint64(bits - 1)).astype(np.int64)


def item_spans(benchmark: DataFrame, span: int, *, item: str, text: str) -> DataFrame:
    """(length, words, items): each distinct span with the sorted ids of the items it is from."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(content or b"")
                length = min(span, len(words))
                if not length:
                    continue
                found = {b" ".join(words[at:at + length]) for at in range(len(words) - length + 1)}
                n = len(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array([length] * n, pa.int32()), pa.array([w.decode() for w in found], pa.string()),
                    pa.array([key] * n, pa.int64())], ["length", "words", "item"])

    rows = benchmark.select(F.col(item).cast("long"), F.col(text)).mapInArrow(cut, "length int, words string, item long")
    return rows.groupBy("length", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def bitmap(spans: DataFrame, span: int, gram: int, bits: int) -> tuple[np.ndarray, list[int]]:
    """The set slots as a packed bitmap of `bits` bits, and the lengths below `span` that occur (12 at most)."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            found = []
            for length, words in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found.append(_slots(fingerprints(words.split(b" "), length, span, gram)[0], bits))
            every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every >> 5), pa.array(1 << (every & 31))], ["cell", "bit"])

    cells = spans.select("length", "words").mapInArrow(slots, "cell long, bit long").groupBy("cell").agg(
        F.bit_or("bit").alias("value"))
    packed = np.zeros(bits // 32, np.uint32)
    for row in cells.toLocalIterator():  # bits / 32 rows at most
        packed[row["cell"]] = row["value"]
    lengths = [row["length"] for row in spans.select("length").filter(F.col("length") < span).distinct().toLocalIterator()]
    return packed, sorted(lengths)


def candidate_spans(
    docs: DataFrame, packed: np.ndarray, lengths: list[int], span: int, gram: int, *, text: str,
) -> DataFrame:
    """The columns of `docs` but `text`, with (n_words, place, length, words): spans around hits.

    A document without any has one row with null words.
    """
    bits = len(packed) * 32
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    wanted = [*lengths, span]
    kept = [field for field in docs.schema.fields if field.name != text]
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("place", T.IntegerType()),
                           T.StructField("length", T.IntegerType()), T.StructField("words", T.StringType())])
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]

    def spans(words: list[bytes]) -> Iterator[tuple]:
        n, found, cells = len(words), False, shared.value
        for length in wanted:
            hashes, places, size = fingerprints(words, length, span, gram)
            slots = _slots(hashes, bits)
            hits = places[(cells[slots >> 5] >> (slots & 31).astype(np.uint32)) & 1 == 1]
            if len(hits):
                # A span of this length that holds the gram starts at most length - size words before it.
                around = hits[:, None] - np.arange(length - size + 1)[None, :]
                for place in np.unique(around[(around >= 0) & (around <= n - length)]).tolist():
                    found = True
                    yield n, place, length, b" ".join(words[place:place + length]).decode()
        if not found:
            yield n, None, None, None

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch, which: list[int], held: list[tuple]) -> pa.RecordBatch:
            at = pa.array(which, pa.int32())
            return pa.RecordBatch.from_arrays([
                *(batch.column(batch.schema.get_field_index(f.name)).take(at) for f in kept),
                *(pa.array(c, k) for c, k in zip(zip(*held), kinds))], schema.names)

        for batch in lean(batches):
            which, held = [], []
            for at, content in enumerate(batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()):
                for row in spans(words_of(content or b"")):
                    which.append(at)
                    held.append(row)
                    if len(held) >= SPAN_ROWS:
                        yield rows(batch, which, held)
                        which, held = [], []
            if held:
                yield rows(batch, which, held)

    return docs.mapInArrow(hit, schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, *, by: Sequence[str], text: str = "text",
    item: str = "item_id", item_text: str = "text", share: int = SHARE, bits: int = BITMAP_BITS,
) -> DataFrame:
    """(*by, n_words, n_hit, n_items, items, contaminated), one row per value of the columns `by`.

    The first of them is a long that is never null and tells texts apart.

    A document word is hit inside any occurrence of `span` words in a row of an
    item; an item of fewer words, but not none, is one span. `items` are the
    items with such spans, sorted as strings. Contaminated: n_hit > 0 and
    share * n_hit >= n_words. Null and empty texts have no words and no hits; an
    item with a null id or without words is not looked for; an empty benchmark
    hits nothing. Copies of items share their spans, so they cost one row more in
    a list, not one more join row. Other columns are not looked at.

    Texts are read once and never shuffled: per document one narrow row, or one
    per candidate span, goes through the join. Documents without a candidate get
    a join key of their own, so they don't meet in one partition.
    """
    items = benchmark.filter(F.col(item).isNotNull())
    spans = materialize(item_spans(items, span, item=item, text=item_text), "spans")
    packed, lengths = bitmap(spans, span, gram, bits)
    by = list(by)
    found = candidate_spans(docs.select(*by, text), packed, lengths, span, gram, text=text)
    lone = F.concat(F.lit("\x00"), F.col(by[0]).cast("string"))  # no word holds this character
    keyed = found.withColumn("words", F.coalesce("words", lone))
    met = keyed.join(spans.select("words", "items"), "words", "left")
    hits = F.when(F.col("items").isNotNull(), F.struct("place", "length"))
    grouped = met.groupBy(*by).agg(
        F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(hits)).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids"))
    # Spans in order of place: each adds the words beyond what has been covered.
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda state, hit: F.struct(
            (state["n"] + F.greatest(F.lit(0), hit["place"] + hit["length"] - F.greatest(state["end"], hit["place"]))).alias("n"),
            F.greatest(state["end"], hit["place"] + hit["length"]).alias("end")), lambda state: state["n"])
    told = grouped.select(
        *by, "n_words", covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"),
        F.sort_array(F.transform("ids", lambda i: i.cast("string"))).alias("items"))
    return told.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, n_words, n_hit, n_items, items, contaminated), one row per row of `docs`; see `contamination`.

    Rows are told apart by their place in the scan, so repeated and null keys
    keep their own rows.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    return contamination(numbered, benchmark, by=["row", "key"], text="text", **options).drop("row").withColumnRenamed("key", key)


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are not contaminated, with the columns of `docs`.

    The decision depends on the text alone, so it is made once per distinct text
    digest and taken back to the documents by it; only contaminated digests are
    joined. A null text stays.
    """
    digest = unused(docs, "digest")
    marked = docs.withColumn(digest, F.xxhash64(text, F.length(text)))
    one = marked.select(F.col(digest).alias("row"), F.col(text).alias("text"))
    found = contamination(one, benchmark, by=["row"], text="text", **options)
    # Written, so that its size is known before texts are joined: few digests are broadcast.
    bad = materialize(found.filter("contaminated").select(F.col("row").alias(digest)), "contaminated")
    return marked.join(bad, digest, "left_anti").select(*docs.columns)
