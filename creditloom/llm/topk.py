"""Exact top-k search by inner product, in three phases with a uniform threshold.

A score is a sum over blocks of columns, and each block gives a local list of
partial scores. First the heads of all lists are gathered; the k-th best of their
whole scores is a safe cutoff t. Whatever scores t or more has at least t / m in
one of m lists, so second each list gives all its entries from there on. What
they add up to, with less than t / m for an entry that a list did not give, is
an upper bound; where every list gave one, it is the score, and the k-th best of
these is a better cutoff. Third, what may still reach it is resolved exactly.

Scores are whole numbers throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

K = 10
LISTS = 2  # blocks of columns; fewer give fewer entries, as the threshold is t / LISTS
SCALE = 1024.0
LARGEST = 1 << 24  # of a component after scaling: products of 2**14 components stay below 2**63
EXACT = 2.0**53  # whole numbers up to here lose nothing in double precision
HEADS = 4  # times k entries at the head of each list
ITEM_ROWS, QUERY_ROWS = 16384, 8192  # of a task
PAIRS = 1 << 22  # partial scores in memory at a time

ENTRY = "q long, item long, list int, part long"


def whole_vector(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of every component, or null where the vector takes no part."""
    scaled = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) >= LARGEST))
    return F.when(~F.coalesce(odd, F.lit(True)) & (F.size(vector) > 0), scaled)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < EXACT else a @ b.T


def _scored(asked: pa.Table, stored: pa.Table):
    """(first query, partial scores) of some queries at a time, within fixed memory."""
    a, b = _matrix(asked["v"]), _matrix(stored["v"])
    step = max(1, PAIRS // len(b))
    for start in range(0, len(a), step):
        yield start, _products(a[start:start + step], b)


def _entries(asked: pa.Table, stored: pa.Table, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    names = ["q", "item", "list", "part"]
    if not found:
        return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int64())], names)
    rows, cols, parts = (np.concatenate(part) for part in zip(*found))
    number = np.full(len(rows), stored["list"][0].as_py(), np.int32)
    return pa.table([asked["q"].take(rows), stored["item"].take(cols), pa.array(number), pa.array(parts)], names)


def _list_heads(depth: int):
    def meet(asked: pa.Table, stored: pa.Table) -> pa.Table:
        """The `depth` best entries of every query in this tile of the list."""
        found = []
        if len(asked) and len(stored):
            for start, parts in _scored(asked, stored):
                most = min(depth, parts.shape[1])
                cols = np.argpartition(-parts, most - 1, axis=1)[:, :most]
                rows = np.repeat(np.arange(len(parts)), most)
                found.append((rows + start, cols.reshape(-1), parts[rows, cols.reshape(-1)]))
        return _entries(asked, stored, found)

    return meet


def _list_entries(asked: pa.Table, stored: pa.Table) -> pa.Table:
    """All entries of this tile of the list from each query's cutoff on."""
    found = []
    if len(asked) and len(stored):
        least = asked["least"].to_numpy()
        for start, parts in _scored(asked, stored):
            rows, cols = np.nonzero(parts >= least[start:start + len(parts), None])
            found.append((rows + start, cols, parts[rows, cols]))
    return _entries(asked, stored, found)


def _kth_best(scored: DataFrame, k: int, name: str) -> DataFrame:
    """(q, name): the k-th best score of each query that has so many."""
    best = Window.partitionBy("q").orderBy(F.desc("score"), "item")
    return scored.withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= k).groupBy("q").agg(
        F.when(F.count(F.lit(1)) == k, F.min("score")).alias(name))


class _Lists:
    """Both sides cut into tiles of rows and lists of columns."""

    def __init__(self, items: DataFrame, questions: DataFrame, width: int, lists: int):
        n_items, n_questions = items.count(), questions.count()
        self.items, self.questions, self.lists = items, questions, lists
        self.item_tiles, self.query_tiles = max(1, -(-n_items // ITEM_ROWS)), max(1, -(-n_questions // QUERY_ROWS))
        cuts = [round(width * at / lists) for at in range(lists + 1)]
        self.columns = F.array(*[
            F.struct(F.lit(at).alias("list"), F.slice("v", a + 1, b - a).alias("v")) for at, (a, b) in enumerate(zip(cuts, cuts[1:]))])

    def _dealt(self, rows: DataFrame, key: str, own: str, own_tiles: int, other: str, other_tiles: int, *more: str) -> DataFrame:
        tiled = rows.select(
            key, *more, F.pmod(F.xxhash64(key), F.lit(own_tiles)).alias(own), F.inline(self.columns))
        return tiled.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_tiles - 1).cast("long"))))

    def meet(self, questions: DataFrame, with_tile, *more: str) -> DataFrame:
        asked = self._dealt(questions, "q", "tq", self.query_tiles, "ti", self.item_tiles, *more)
        stored = self._dealt(self.items, "item", "ti", self.item_tiles, "tq", self.query_tiles)
        tile = ["list", "ti", "tq"]
        return asked.groupBy(*tile).cogroup(stored.groupBy(*tile)).applyInArrow(with_tile, ENTRY)

    def resolve(self, pairs: DataFrame) -> DataFrame:
        """(q, item, score) of (q, item) pairs."""
        products = F.zip_with("a", "b", lambda x, y: x * y)
        return pairs.join(self.items.select("item", F.col("v").alias("b")), "item").join(
            self.questions.select("q", F.col("v").alias("a")), "q").select(
            "q", "item", F.aggregate(products, F.lit(0).cast("long"), lambda total, x: total + x).alias("score"))


def _search(items: DataFrame, questions: DataFrame, width: int, k: int, lists: int) -> DataFrame:
    """(q, item, score) of at least the k best items of every query, and all that score what the last of them does."""
    held = _Lists(items, questions, width, max(1, min(lists, width)))
    m = held.lists
    # 1. The heads of the lists, over all tiles, and what their items score.
    depth = HEADS * k
    in_list = Window.partitionBy("q", "list").orderBy(F.desc("part"), "item")
    heads = held.meet(questions, _list_heads(depth)).withColumn("turn", F.row_number().over(in_list)).filter(F.col("turn") <= depth)
    known = materialize(held.resolve(heads.select("q", "item").distinct()), "heads")
    # 2. A query without k items there has no cutoff: it gets every entry, and there are few.
    cutoff = questions.join(_kth_best(known, k, "cutoff"), "q", "left").select("q", "v", "cutoff", F.coalesce(
        F.ceil(F.col("cutoff").cast("decimal(20,0)") / m).cast("long"), F.lit(-(1 << 62))).alias("least"))
    asked = materialize(cutoff, "cutoffs")
    entries = held.meet(asked, _list_entries, "least")
    summed = materialize(entries.groupBy("q", "item").agg(
        F.sum("part").alias("seen"), F.count(F.lit(1)).cast("int").alias("given")), "entries")
    # 3. What every list gave is a score; the rest is resolved where its upper bound reaches the better cutoff.
    whole = summed.filter(F.col("given") == m).select("q", "item", F.col("seen").alias("score"))
    better = _kth_best(whole, k, "better")
    told = asked.select("q", "least", "cutoff").join(better, "q", "left").select(
        "q", "least", F.greatest("cutoff", "better").alias("bar"))
    upper = F.col("seen") + (m - F.col("given")) * (F.col("least") - 1)
    open_pairs = summed.filter(F.col("given") < m).join(told, "q").filter(F.col("bar").isNull() | (upper >= F.col("bar")))
    return whole.unionByName(held.resolve(open_pairs.select("q", "item")))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, *, key: str = "vec_id", vector: str = "embedding",
    scale: float = SCALE, lists: int = LISTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` largest inner products of floor(scale * x), for each query row.

    Queries are the rows where `is_query` holds, candidates all rows with another id; fewer candidates give
    fewer rows. Ties go to the smaller id. Rows take no part if their id is null, or their vector is null,
    empty, of another length than most, or holds a null, a non-finite component or one of 2**24 or more after
    scaling. A row repeated with id and vector counts once; an id with two vectors is two candidates, and two
    queries that share their number. Other columns are not looked at; an empty table has no result.

    Equal vectors are one item with their k + 1 smallest ids, which is all a query can need, and equal queries
    are searched once, so a vector that a third of all rows share costs what one does. A task holds one list of
    one tile of items and one of queries.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), whole_vector(F.col(vector), scale).alias("v"), is_query.alias("asks")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull())
    widths = list(rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).toLocalIterator())
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = widths[0]["width"]
    rows = rows.filter(F.size("v") == width)
    lowest = Window.partitionBy("v").orderBy("id")
    kept = rows.select("id", "v").withColumn("turn", F.dense_rank().over(lowest)).filter(F.col("turn") <= k + 1)
    grouped = kept.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    items = materialize(grouped.withColumn("item", F.monotonically_increasing_id()), "items")
    asked = rows.filter(F.coalesce("asks", F.lit(False))).select("id", "v").distinct()
    questions = materialize(asked.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "questions")
    scored = _search(items, questions, width, k + 1, lists)
    named = scored.join(items.select("item", "ids"), "item")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    top = named.withColumn("turn", F.rank().over(best)).filter(F.col("turn") <= k + 1)
    listed = top.join(questions, "q").select("v", F.explode("ids").alias("vec_id"), "score")
    others = asked.select(F.col("id").alias("query_id"), "v").join(listed, "v").filter(F.col("vec_id") != F.col("query_id"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return others.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
