"""SimHash near-duplicates by a generalised pigeonhole.

Fingerprints are collapsed to distinct values first, so copies cost nothing. The
64 bits are cut into parts, bits that agree more often than not in the same part,
and a fingerprint gives every part a threshold of its own: if the thresholds t_i
satisfy sum(t_i + 1) = distance + 1, a fingerprint within the distance differs in
at most t_i bits in some part i. A dynamic program picks the thresholds with the
fewest expected signatures and candidates, read off the counts of
the part values over all fingerprints. Signatures are joined with the exact part values, candidates
verified on all bits, and links reduced to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .components import components
from .parts import lean, slices

SHINGLE, DISTANCE, SEED, BITS = 4, 4, 42, 64
HASHES = 1 << 16  # shingle hashes held at a time


# --- Fingerprints ---------------------------------------------------------------------

def fingerprint_of(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a UTF-8 text. Bit set where over half the shingle hashes have it; no word: 0."""
    words = text.lower().split()  # bytes: A-Z only, white space is space and 0x09-0x0D
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    starts, ends = starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist()
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), HASHES):
        hashes = np.fromiter(
            (digest(joined[s:e], seed) for s, e in zip(starts[at:at + HASHES], ends[at:at + HASHES])), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """Fingerprint of a text column as a (signed) long; null counts as empty."""

    @F.arrow_udf(T.LongType())
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in lean(batches):
            found = [fingerprint_of(t or b"", shingle, seed) for texts in slices(batch.cast(pa.binary())) for t in texts]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return prints(text)


def hex_digits(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


# --- Partitions and thresholds ------------------------------------------------------------

def bit_parts(ones: np.ndarray, both: np.ndarray, n: int, count: int) -> list[list[int]]:
    """Cut the bits into `count` parts of nearly equal size, the most correlated together.

    `ones[i]` and `both[i, j]` count fingerprints with bit i, with bits i and j.
    """
    share = ones / max(n, 1)
    cover = both / max(n, 1) - np.outer(share, share)
    spread = np.sqrt(np.maximum(np.diag(cover), 1e-12))
    close = np.abs(cover / np.outer(spread, spread))
    left, parts = list(range(len(ones))), []
    for at in range(count):
        size = -(-len(left) // (count - at))
        part = [max(left, key=lambda b: (close[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < size:
            part.append(max(left, key=lambda b: (close[b, part].sum(), -b)))
            left.remove(part[-1])
        parts.append(sorted(part))
    return parts


def signature_count(width: int, threshold: int) -> int:
    return sum(_choose(width, r) for r in range(threshold + 1))


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def allocate(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds (-1: part not probed) with sum(t + 1) = distance + 1 and the least cost.

    `costs[i][t]` is the expected work of probing part i with threshold t. The
    table over (parts seen, budget spent) is filled part by part.
    """
    budget = distance + 1
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * budget
    for cost in costs:
        following: list[tuple[float, list[int]] | None] = [None] * (budget + 1)
        for spent, state in enumerate(best):
            if state is None:
                continue
            for t in range(-1, min(distance, len(cost) - 1, budget - spent - 1) + 1):
                total = state[0] + (cost[t] if t >= 0 else 0.0)
                at = spent + t + 1
                if following[at] is None or total < following[at][0]:
                    following[at] = (total, [*state[1], t])
        best = following
    if best[budget] is None:
        raise ValueError("the parts are too narrow for this distance")
    return best[budget][1]


def plan_parts(n: int, ones: np.ndarray, both: np.ndarray, collisions, distance: int) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds with the least expected work.

    `collisions(cuts)` gives, per cut and part, the mean number of fingerprints
    that share a part value with a fingerprint, itself included.
    """
    plans = []
    cuts = [bit_parts(ones, both, n, count) for count in range(2, distance + 2)] or [bit_parts(ones, both, n, 1)]
    for parts, found in zip(cuts, collisions(cuts)):
        costs = []
        for part, same in zip(parts, found):
            uniform = n / 2.0 ** len(part)
            costs.append([
                signature_count(len(part), t) + same + (signature_count(len(part), t) - 1) * max(uniform, (same - 1) / len(part))
                for t in range(min(distance, 3) + 1)])
        thresholds = allocate(costs, distance)
        plans.append((sum(c[t] for c, t in zip(costs, thresholds) if t >= 0), parts, thresholds))
    _, parts, thresholds = min(plans, key=lambda plan: plan[0])
    return parts, thresholds


def _part_value(value: Column, part: list[int]) -> Column:
    """The bits of a part, moved together."""
    out = F.lit(0).cast("long")
    for to, bit in enumerate(part):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, bit).bitwiseAND(F.lit(1).cast("long")), to))
    return out


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints in column `print` that differ in 1 to `distance` bits.

    `prints` holds each fingerprint once and is read several times.
    """
    value = F.col("print")
    both = _bit_pairs(prints)
    n = int(both[BITS, BITS])

    def collisions(plans: list[list[list[int]]]) -> list[list[float]]:
        """Sum of squares of a part's value counts over the number of fingerprints; one row per part."""
        flat = [part for parts in plans for part in parts]
        values = F.explode(F.array(*[
            F.struct(F.lit(at).alias("part"), _part_value(value, part).alias("v")) for at, part in enumerate(flat)]))
        counted = prints.select(values.alias("p")).groupBy("p.part", "p.v").agg(F.count(F.lit(1)).cast("double").alias("c"))
        found = {row["part"]: row["s"] for row in counted.groupBy("part").agg(F.sum(F.col("c") * F.col("c")).alias("s")).toLocalIterator()}
        mean = iter([found.get(at, 0.0) / max(n, 1) for at in range(len(flat))])
        return [[next(mean) for _ in parts] for parts in plans]

    parts, thresholds = plan_parts(n, np.diag(both)[:BITS].copy(), both[:BITS, :BITS], collisions, distance)
    probed = [(at, part, t) for at, (part, t) in enumerate(zip(parts, thresholds)) if t >= 0]
    exact = F.explode(F.array(*[
        F.struct(F.lit(at).alias("part"), _part_value(value, part).alias("v")) for at, part, _ in probed]))
    signatures = F.explode(F.concat(*[_signatures(value, at, part, t) for at, part, t in probed]))
    stored = prints.select(value.alias("b"), exact.alias("k")).select("b", "k.*")
    asked = prints.select(value.alias("a"), signatures.alias("k")).select("a", "k.*")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = asked.join(stored, ["part", "v"]).filter((F.col("a") < F.col("b")) & (differ <= distance))
    return near.select("a", "b").distinct()


def _bit_pairs(prints: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j, and at [BITS, BITS] how many there are: 65 x 65 sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in lean(batches):
            octets = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.ones((len(octets), BITS + 1), np.float32)
            bits[:, :BITS] = np.unpackbits(octets, axis=1, bitorder="little")
            for at in range(0, len(bits), HASHES):
                part = bits[at:at + HASHES]
                total += part.T @ part
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], ["cell", "n"])

    cells = prints.select("print").mapInArrow(count, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros((BITS + 1) ** 2)
    for row in cells.toLocalIterator():
        out[row["cell"]] = row["n"]
    return out.reshape(BITS + 1, BITS + 1)


def _signatures(value: Column, at: int, part: list[int], threshold: int) -> Column:
    """All (part, value) within the threshold of a fingerprint's part."""
    masks = F.array(*[F.lit(mask).cast("long") for mask in _masks(len(part), threshold)])
    return F.transform(masks, lambda mask: F.struct(
        F.lit(at).alias("part"), _part_value(value, part).bitwiseXOR(mask).alias("v")))


def _masks(width: int, threshold: int) -> list[int]:
    return [sum(1 << b for b in chosen) for r in range(threshold + 1) for chosen in combinations(range(width), r)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


# --- Groups ---------------------------------------------------------------------------------

def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, *, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, fingerprint, component_id), one row per row of `docs`.

    Documents whose fingerprints differ in `distance` bits or fewer are linked;
    `component_id` is the smallest key that can be reached, itself included.
    Null and empty texts have fingerprint zero and are linked like any other;
    a null key is reached but never the smallest unless there is no other;
    repeated rows give repeated results; other columns are not looked at.

    Texts are read once and never shuffled. Everything after that works on
    distinct fingerprints; a group of copies is one of them, whatever its size.
    """
    printed = materialize(
        docs.select(F.col(key).alias("key"), fingerprint(F.col(text), shingle).alias("print")), "fingerprints")
    groups = component_of(printed, distance)
    return printed.join(groups.select("print", "component_id"), "print").select(
        F.col("key").alias(key), hex_digits(F.col("print")).alias("fingerprint"), "component_id")


def component_of(printed: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(print, root, least, component_id), one row per distinct fingerprint.

    `root` names the component, `least` is the smallest key with this fingerprint
    and `component_id` the smallest key in the component.
    """
    prints = materialize(printed.groupBy("print").agg(F.min("key").alias("least")), "prints")
    found = materialize(links(prints.select("print"), distance), "links")
    grouped = components(found)
    rooted = materialize(prints.join(grouped, prints["print"] == grouped["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")), "rooted")
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")


def keep_one(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, *, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows of `docs` with one document of each near-duplicate group: the one with the smallest key.

    Of rows that share key and fingerprint the one with the smallest text stays
    (null first); a null key stays only where a group has no other. Columns are
    those of `docs`, whatever they are called. Texts are shuffled once, by key
    and fingerprint, so a group of copies is dealt over all partitions.
    """
    added = {name: unused(docs, name) for name in ("print", "known", "keyed", "turn")}
    print_, known, keyed, turn = added.values()
    marked = docs.withColumns({
        print_: fingerprint(F.col(text), shingle), known: F.col(key).isNotNull(), keyed: F.coalesce(F.col(key), F.lit(0))})
    printed = materialize(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), shingle).alias("print")), "fingerprints")
    groups = component_of(printed, distance)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "print")).alias("first"))
    kept = first.select(
        F.col("first.print").alias(print_), F.col("first.least").isNotNull().alias(known),
        F.coalesce(F.col("first.least"), F.lit(0)).alias(keyed))
    same = [print_, known, keyed]
    one = F.row_number().over(Window.partitionBy(*same).orderBy(text))
    return marked.join(kept, same, "left_semi").withColumn(turn, one).filter(F.col(turn) == 1).select(*docs.columns)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have."""
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
