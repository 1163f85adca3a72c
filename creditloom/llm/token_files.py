"""Token ids in binary shards with fixed-width bit packing.

Each id takes the minimum number of bits its vocabulary needs. Documents are
dealt to shards by ranges of their key and sorted inside, so shards in the order
of their names hold all documents in ascending order. A shard is a run of
segments; a segment is, in little-endian order:

    magic 8 bytes | width u32 | block u32 | documents u64 | ids u64
    key present u8 per document | keys i64 per document | lengths u64 per document
    block offsets u64, one more than there are blocks, counted from the payload
    payload: blocks of `block` ids, each packed on its own | one separator byte

Id i of a segment is in block i // block at bit (i % block) * width: any span
can be read without what comes before it, and a block is unpacked by NumPy in
one go. Spark's own text writer puts the segments down, so shards go to any file
system Spark can reach and a lost task leaves nothing behind.
"""

from __future__ import annotations

import gc
import json
import os
import struct
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .parts import PRINTABLE, Cutter, PieceCache, give_back, in_slices, lean

MAGIC = b"IDPACK01"
HEAD = "<8sIIQQ"
BLOCK = 1 << 13
SEGMENT_IDS = 1 << 17  # a segment is closed at the first document that reaches it
SEGMENTS_PER_FILE = 32
SEPARATOR = "\n"
TASK_BYTES = 24 << 20  # of text for a task; more texts in a task share more of their parts

SLICE_CHARS = 1 << 21  # texts looked at together
DOCS = 500  # documents taken from a batch at a time
JOINED = 64  # pieces encoded in one call
PIECES_HELD = 250_000


# --- Packing ------------------------------------------------------------------------

def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Bit k of id i is bit i * width + k of the result, least significant first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little")[:, :width], bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count=n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    padded = np.zeros((n, 32), np.uint8)
    padded[:, :width] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").reshape(n)


def write_segment(keys: Sequence[int | None], documents: Sequence[np.ndarray], width: int, block: int = BLOCK) -> bytes:
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    blocks = [pack(ids[at:at + block], width) for at in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    return b"".join([
        struct.pack(HEAD, MAGIC, width, block, len(documents), len(ids)),
        np.array([key is not None for key in keys], np.uint8).tobytes(),
        np.array([key or 0 for key in keys], "<i8").tobytes(),
        np.array([len(d) for d in documents], "<u8").tobytes(), offsets.tobytes(), *blocks,
    ])


class Segment:
    """A view of one segment; nothing is unpacked before it is asked for."""

    def __init__(self, data: memoryview):
        magic, self.width, self.block, n, self.n_ids = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at = struct.calcsize(HEAD)
        present = np.frombuffer(data, np.uint8, n, at)
        keys = np.frombuffer(data, "<i8", n, at + n)
        self.keys = [int(k) if p else None for k, p in zip(keys, present)]
        self.starts = np.cumsum([0, *np.frombuffer(data, "<u8", n, at + 9 * n)], dtype=np.int64)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at + 17 * n).astype(np.int64)
        self.payload = data[at + 17 * n + 8 * (blocks + 1):]
        self.size = at + 17 * n + 8 * (blocks + 1) + int(self.offsets[-1])

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start..end of the segment; only the blocks they lie in are unpacked."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        found = [
            unpack(self.payload[self.offsets[b]:self.offsets[b + 1]], min(self.block, self.n_ids - b * self.block), self.width)
            for b in range(first, last + 1)
        ]
        return np.concatenate(found)[start - first * self.block:end - first * self.block]

    def document(self, at: int) -> np.ndarray:
        return self.ids(int(self.starts[at]), int(self.starts[at + 1]))


def segments(data: bytes) -> Iterator[Segment]:
    """All segments of a shard."""
    view, at = memoryview(data), 0
    while at < len(view):
        segment = Segment(view[at:])
        yield segment
        at += segment.size + len(SEPARATOR)


# --- Encoding -------------------------------------------------------------------------

def _without_model(path: str) -> str:
    """A tokenizer file without its model, which is nearly all of it and comes last."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    return text[:text.index('"model"')].rstrip().rstrip(",") + "}"


class Encoder:
    """Ids by the tokenizers library; what comes again in a task is encoded once.

    A byte-level tokenizer starts a new token at every single space between two
    characters that are not white space. So only pieces that are new go to the
    library, many at a time with a token between them. Most of the library's time
    is its search for the ends of words; plain pieces are words already and go
    straight to its model. Texts, pieces and tokenizers that don't fit this go to
    the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        described = json.loads(_without_model(path))
        added, first = described["added_tokens"], described.get("pre_tokenizer") or {}
        self.between, self.between_id = (added[0]["content"], added[0]["id"]) if added else ("", None)
        self.cuts = (
            bool(added) and described.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex")
            and not first.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] or " " in t["content"] for t in added))
        newline = self.library.encode("\n", add_special_tokens=False).ids
        self.newline_id, self.cuts = newline[0] if newline else None, self.cuts and len(newline) == 1
        # The same model behind a tokenizer that only cuts at line ends.
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.apart = chr(PRINTABLE[0])  # no plain piece has the byte zero
        self.apart_id = self.words.token_to_id(self.apart)
        self.cuts = self.cuts and self.apart_id is not None
        self.cutter = Cutter(t["content"] for t in added)
        self.pieces = PieceCache(self.cutter, self._plain, self._other, PIECES_HELD)

    def encode(self, texts: Sequence[str], end_id: int) -> Iterator[np.ndarray]:
        end = np.array([end_id], "<u4")
        for some in in_slices(texts, SLICE_CHARS):
            for ids in self._slice(some) if self.cuts else self._library(some):
                yield np.concatenate([ids, end])

    def _library(self, texts: Sequence[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(list(texts), add_special_tokens=False) if texts else []
        return [np.array(e.ids, "<u4") for e in found]

    def _slice(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        cut = self.cutter.cut(texts)
        values, loose = self.pieces.results(cut.pieces)
        whole = cut.whole(loose)
        values = [value or b"" for value in values]
        ids, held = np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4
        lengths = held[cut.number]
        ends = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        places = np.repeat((np.cumsum(held) - held)[cut.number] - ends[:-1], lengths)
        places += np.arange(len(places))
        every, edges = ids[places], ends[cut.first].tolist()
        uncut = iter(self._library([text for text, all_ in zip(texts, whole) if all_]))
        for all_, a, b in zip(whole, edges, edges[1:]):
            yield next(uncut) if all_ else every[a:b]

    def _plain(self, pieces: list[str]) -> list[bytes]:
        """Ids of plain pieces, given in the characters that stand for their bytes."""
        out, between = [], f"\n{self.apart}\n"
        for at in range(0, len(pieces), JOINED):
            joined = between.join(pieces[at:at + JOINED])
            out += self._apart(self.words.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.apart_id)
        return out

    @staticmethod
    def _apart(ids: list[int], cut: int) -> list[bytes]:
        found = np.array(ids, "<u4")
        edges = (4 * np.flatnonzero(found == cut)).tolist()
        data = found.tobytes()
        return [data[a:b] for a, b in zip([0, *[e + 4 for e in edges]], [*edges, len(data)])]

    def _other(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces by the library as a whole; those without a space in front each by themselves."""
        alone = [piece for piece in pieces if piece[0] != " " or self.between in piece]
        out = dict(zip(alone, (ids.tobytes() for ids in self._library(alone))))
        new = [piece for piece in pieces if piece not in out]
        # A newline before " part" is a token of its own, cheaper to cut at than a special one.
        for some, between, cut in (([p for p in new if "\n" not in p], "\n", self.newline_id), ([p for p in new if "\n" in p], self.between, self.between_id)):
            for at in range(0, len(some), JOINED):
                batch = some[at:at + JOINED]
                out.update(zip(batch, self._apart(self.library.encode_batch_fast([between.join(batch)], add_special_tokens=False)[0].ids, cut)))
        return [out[piece] for piece in pieces]


# --- Spark ------------------------------------------------------------------------------

def write_token_files(
    docs: DataFrame, folder: str, path: str, end_id: int, vocabulary: int, *, key: str = "doc_id", text: str = "text",
) -> None:
    """Encode, append `end_id` to each document and write shards below `folder`, in ascending order of `key`.

    Null keys come first; rows with equal keys are ordered by a hash of their
    texts, then by the texts. A null text is encoded as empty. A document is never cut: a
    segment, and so a task's memory, is bounded by SEGMENT_IDS and the longest
    document. Other columns are not looked at. An empty table writes no segment.
    """
    width = bits_for(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here forms cycles, and the collector would walk all that is remembered
        encoder, keys, documents, held = Encoder(path), [], [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([write_segment(keys, documents, width)], pa.binary())], ["segment"])

        for batch in lean(batches):
            for part in (batch.slice(at, DOCS) for at in range(0, len(batch), DOCS)):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for k, ids in zip(part.column(0).to_pylist(), encoder.encode(texts, end_id)):
                    keys.append(k)
                    documents.append(ids)
                    held += len(ids)
                    if held >= SEGMENT_IDS:
                        yield packed()
                        keys, documents, held = [], [], 0
        if documents:
            yield packed()
        gc.enable()
        del encoder, documents
        give_back()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ordered = rows.repartitionByRange(max(1, -(-size // TASK_BYTES)), "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    packed = ordered.mapInArrow(encode, "segment binary")
    # The text writer puts bytes down as they are.
    packed.select(F.col("segment").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", SEGMENTS_PER_FILE).option("lineSep", SEPARATOR).text(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_bits), one row per document of the shards below `folder`.

    `start` counts the ids of all documents before it. Shards are read whole,
    one at a time; their size is bounded by the writer. The totals that starts
    are offset by are one row per shard.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for at in range(len(batch)):
                shard, before = batch.column(0)[at].as_py(), 0
                data = batch.column(1)[at].as_buffer()
                for segment in segments(memoryview(data)):
                    n, starts = len(segment.keys), (4 * segment.starts).tolist()
                    every = memoryview(segment.ids(0, segment.n_ids).astype("<u4").tobytes())
                    sums = [crc32(every[a:b]) for a, b in zip(starts, starts[1:])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard] * n, pa.string()), pa.array(segment.keys, pa.int64()),
                        pa.array(before + segment.starts[:-1], pa.int64()), pa.array(np.diff(segment.starts), pa.int64()),
                        pa.array(sums, pa.int64()), pa.array([segment.width] * n, pa.int32()),
                    ], ["shard", "doc_id", "inside", "n_tokens", "ids_crc32", "n_bits"])
                    before += segment.n_ids

    files = spark.read.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "part-*").load(folder)
    shard = F.regexp_extract("path", "[^/]+$", 0)
    rows = materialize(files.select(shard.alias("shard"), "content").mapInArrow(
        parse, "shard string, doc_id long, inside long, n_tokens long, ids_crc32 long, n_bits int"), "token-rows")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    # Part number first, then the running number of a task's files.
    part = F.regexp_extract("shard", "part-([0-9]+)", 1).cast("long")
    file = F.coalesce(F.regexp_extract("shard", "-c([0-9]+)", 1).try_cast("long"), F.lit(0))
    ahead = Window.orderBy(part, file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("ahead"))
    return rows.join(offsets, "shard").select(
        "doc_id", (F.col("ahead") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "n_bits")
