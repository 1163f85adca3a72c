"""Approximate nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Vectors get one more component that makes them all equally long; then the
largest inner product is the smallest distance. A random rotation spreads the
information evenly over the components, so the first d of D estimate a distance
as D / d times what they give. Within each probed list candidates are compared
block of columns by block of columns, and abandoned as soon as a hypothesis test
says that the whole distance is above the k-th best so far: the estimate beyond
(1 + epsilon / sqrt(d)) squared times that distance. What is left after the last
block gets its exact inner product, in double precision, on the given vectors.

The index (centroids, rotation, number of lists to probe) is fitted on a bounded
sample of SAMPLE vectors; every vector is in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

K = 20
SAMPLE = 20_000  # vectors the index is fitted on, at most
SAMPLE_QUERIES = 500
MOST_LISTS = 1024
COVERAGE = 0.975  # of the sample's neighbours that the probed lists must hold
EPSILON = 3.0  # of the hypothesis test; larger abandons later
COLUMNS = 16  # of a block
BIN_ROWS = 8192  # vectors of a task
QUERY_ROWS = 4096  # queries of a task
SPARSE = 0.02  # share of pairs left from which they are picked one by one
PAIRS = 1 << 20  # query-vector pairs compared at a time
SEED = 11


@dataclass(frozen=True)
class Index:
    """All that is sent to tasks: bounded by MOST_LISTS and the width of a vector."""

    rotation: np.ndarray
    centroids: np.ndarray  # in the rotated space
    probes: int
    longest: float  # squared length of the longest vector
    sizes: np.ndarray | None = None  # vectors of each list

    def points(self, vectors: np.ndarray) -> np.ndarray:
        """Stored vectors with the equalising component, rotated."""
        extra = np.sqrt(np.maximum(self.longest - (vectors * vectors).sum(axis=1), 0.0))
        return np.column_stack([vectors, extra]) @ self.rotation

    def asked(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.rotation[:vectors.shape[1]]

    def list_of(self, points: np.ndarray) -> np.ndarray:
        return _closeness(points, self.centroids).argmax(axis=1)

    def probed(self, asked: np.ndarray, k: int) -> np.ndarray:
        """(queries, lists): whether a query looks into a list. The nearest ones, until they hold k vectors."""
        order = np.argsort(-_closeness(asked, self.centroids), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        wanted = (np.arange(order.shape[1]) < self.probes) | (held < k)
        looks = np.zeros(order.shape, bool)
        np.put_along_axis(looks, order, wanted, axis=1)
        return looks & (self.sizes > 0)


def _closeness(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return points @ centroids.T - 0.5 * (centroids * centroids).sum(axis=1)


def fit_index(sample: np.ndarray, longest: float, n: int, k: int = K, seed: int = SEED) -> Index:
    """`n` is the number of vectors the index will hold."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1] + 1
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    lists = max(1, min(MOST_LISTS, round(n ** 0.5), len(sample)))
    index = Index(rotation, np.zeros((1, width)), 1, longest)
    points = index.points(sample)
    centroids = points[rng.choice(len(points), lists, replace=False)]
    for _ in range(10):
        at = np.concatenate([_closeness(points[i:i + 4096], centroids).argmax(axis=1) for i in range(0, len(points), 4096)])
        sizes = np.bincount(at, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, points)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    index = Index(rotation, centroids, lists, longest)
    at = np.concatenate([index.list_of(points[i:i + 4096]) for i in range(0, len(points), 4096)])
    chosen = rng.choice(len(sample), min(SAMPLE_QUERIES, len(sample)), replace=False)
    asked = index.asked(sample[chosen])
    order = np.argsort(np.argsort(-_closeness(asked, centroids), axis=1), axis=1)  # turn of each list
    products = sample[chosen] @ sample.T
    products[np.arange(len(chosen)), chosen] = -np.inf
    most = min(k, len(sample) - 1)
    if most < 1:
        return index
    best = np.argpartition(-products, most - 1, axis=1)[:, :most]
    turns = np.sort(np.take_along_axis(order, at[best], axis=1).reshape(-1))
    needed = int(turns[min(len(turns) - 1, int(np.ceil(COVERAGE * len(turns))) - 1)]) + 1
    return Index(rotation, centroids, needed, longest)


class Best:
    """The k best (product, id) of each query; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.products = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    @property
    def least(self) -> np.ndarray:
        return self.products[:, -1]

    def offer(self, rows: np.ndarray, products: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(touched, self.k)])
        products = np.concatenate([products, self.products[touched].reshape(-1)])
        ids = np.concatenate([ids, self.ids[touched].reshape(-1)])
        order = np.lexsort((ids, -products, rows))
        rows, products, ids = rows[order], products[order], ids[order]
        first = np.searchsorted(rows, touched)
        place = first[:, None] + np.arange(self.k)[None, :]
        self.products[touched], self.ids[touched] = products[place], ids[place]


def scan(asked: np.ndarray, points: np.ndarray, least: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) that no test has abandoned. `least`: squared distance of each query's k-th best."""
    width = points.shape[1]
    dense = np.zeros((len(asked), len(points)))
    alive, rows, cols, partial = None, None, None, None
    for start in range(0, width, COLUMNS):
        end = min(start + COLUMNS, width)
        a, b = asked[:, start:end], points[:, start:end]
        slack = 1.0 if end == width else (1.0 + EPSILON / np.sqrt(end)) ** 2 * (end / width)
        bound = least * slack + 1e-9 * index.longest  # rounding
        if rows is None:
            # Many pairs left: one product of matrices is cheaper than picking them.
            dense += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
            stay = dense <= bound[:, None]
            alive = stay if alive is None else alive & stay
            if end == width or np.count_nonzero(alive) < SPARSE * alive.size:
                rows, cols = np.nonzero(alive)
                partial = dense[rows, cols]
        else:
            difference = a[rows] - b[cols]
            partial = partial + np.einsum("ij,ij->i", difference, difference)
            stay = partial <= bound[rows]
            rows, cols, partial = rows[stay], cols[stay], partial[stay]
    return rows, cols


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


def usable(vector: Column) -> Column:
    """Not null, not zero, every component there and finite."""
    def odd(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = K, *, key: str = "vec_id", vector: str = "embedding", probes: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` largest inner products found for each query row.

    Queries are the rows where `is_query` holds, candidates all rows with another
    id. Ties go to the smaller id. Rows take no part if their id is null, or
    their vector is null, zero, of another length than most, or holds a null or
    non-finite component. A row repeated with id and vector counts once; an id
    with two vectors is two candidates, and two queries that share their number.
    `probes` overrides how many lists are looked into. Other columns are not
    looked at; an empty table has no result.

    Equal vectors are one candidate with their k + 1 smallest ids, which is all a
    query can need, and equal queries are searched once, so a vector that a third
    of all rows share costs what one does. Lists are packed into bins of a fixed
    number of vectors, large lists cut over several bins; a task holds one bin
    and a fixed number of queries, and returns k + 1 rows per query.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("asks")).filter(
        F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    widths = list(rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).toLocalIterator())
    empty = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], empty)
    rows = rows.filter(F.size("v") == widths[0]["width"])
    lowest = Window.partitionBy("v").orderBy("id")
    kept = rows.select("id", "v").withColumn("turn", F.dense_rank().over(lowest)).filter(F.col("turn") <= k + 1)
    items = materialize(kept.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")), "items")
    asked = rows.filter(F.coalesce("asks", F.lit(False))).select("id", "v").distinct()
    questions = materialize(asked.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "questions")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    told = items.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).first()
    sample = items.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE)
    index = fit_index(_matrix(sample.toArrow().column(0)), told["longest"], told["n"], k)
    if probes is not None:
        index = Index(index.rotation, index.centroids, max(1, min(probes, len(index.centroids))), index.longest)
    found = _search(items, questions, index, k + 1)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= k + 1)
    listed = top.join(questions, "q").select("v", "vec_id", "score")
    others = asked.select(F.col("id").alias("query_id"), "v").join(listed, "v").filter(F.col("vec_id") != F.col("query_id"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return others.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _search(items: DataFrame, questions: DataFrame, index: Index, k: int) -> DataFrame:
    """(q, vec_id, score): the k best of each task's bin."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = index.list_of(index.points(_matrix(batch.column(0))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], ["v", "ids", "list"])

    placed = materialize(items.select("v", "ids").mapInArrow(listed, "v array<double>, ids array<long>, list int"), "lists")
    sizes = {row["list"]: row["count"] for row in placed.groupBy("list").count().toLocalIterator()}
    bins, room, at = {}, 0, -1  # list -> (first bin, bins)
    for name, size in sorted(sizes.items()):
        if size > BIN_ROWS:
            parts = -(-size // BIN_ROWS)
            bins[name], at, room = (at + 1, parts), at + parts, 0
        else:
            if size > room:
                at, room = at + 1, BIN_ROWS
            bins[name], room = (at, 1), room - size
    index = replace(index, sizes=np.array([sizes.get(at, 0) for at in range(len(index.centroids))]))
    first = F.create_map(*[F.lit(x) for name, (a, _) in bins.items() for x in (name, a)])
    parts = F.create_map(*[F.lit(x) for name, (_, p) in bins.items() for x in (name, p)])
    part = F.pmod(F.xxhash64("v"), F.element_at(parts, F.col("list"))).cast("int")
    binned = placed.withColumn("bin", F.element_at(first, F.col("list")) + part)

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = index.asked(_matrix(batch.column(1)))
            which, where, lists = [], [], []
            for row, looks in enumerate(index.probed(asked, k)):
                visits: dict[int, list[int]] = {}
                for name in np.flatnonzero(looks).tolist():
                    for b in range(bins[name][0], sum(bins[name])):
                        visits.setdefault(b, []).append(name)
                which += [row] * len(visits)
                where += visits.keys()
                lists += visits.values()
            taken = batch.take(pa.array(which, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(where, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["q", "v", "bin", "lists"])

    visits = materialize(questions.select("q", "v").mapInArrow(probing, "q long, v array<double>, bin int, lists array<int>"), "visits")
    # A bin is copied as often as its own visitors need.
    copies = materialize(visits.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("copies")), "copies")
    right = visits.join(copies, "bin").select("q", "v", "bin", "lists", F.pmod(F.xxhash64("q"), F.col("copies")).cast("int").alias("part"))
    left = binned.join(copies, "bin").select("v", "ids", "list", "bin", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"))

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        names, kinds = ["q", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        if not len(ours) or not len(theirs):
            return pa.table([pa.array([], kind) for kind in kinds], names)
        stored, asked = _matrix(ours["v"]), _matrix(theirs["v"])
        points, turned = index.points(stored), index.asked(asked)
        home = ours["list"].to_numpy()
        ids = ours["ids"].combine_chunks()
        offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        lists = theirs["lists"].combine_chunks()
        visits = np.zeros((len(asked), int(home.max()) + 1), bool)
        rows = np.repeat(np.arange(len(asked)), np.diff(lists.offsets.to_numpy()))
        wanted = lists.flatten().to_numpy()
        inside = wanted < visits.shape[1]
        visits[rows[inside], wanted[inside]] = True
        squares = (asked * asked).sum(axis=1)
        best = Best(len(asked), k)
        for name in np.unique(home).tolist():
            members, visitors = np.flatnonzero(home == name), np.flatnonzero(visits[:, name])
            step = max(1, PAIRS // len(members))
            for at in range(0, len(visitors), step):
                who = visitors[at:at + step]
                bound = squares[who] + index.longest - 2.0 * best.least[who]
                r, c = scan(turned[who], points[members], bound, index)
                r, c = who[r], members[c]
                products = np.empty(len(r))
                for cut in range(0, len(r), 1 << 16):
                    s = slice(cut, cut + (1 << 16))
                    products[s] = np.einsum("ij,ij->i", asked[r[s]], stored[c[s]])
                good = products >= best.least[r]
                r, c, products = r[good], c[good], products[good]
                many = offsets[c + 1] - offsets[c]
                spots = np.repeat(offsets[c], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                best.offer(np.repeat(r, many), np.repeat(products, many), flat[spots])
        rows, cols = np.nonzero(np.isfinite(best.products))
        return pa.table([
            pa.array(theirs["q"].to_numpy()[rows]), pa.array(best.ids[rows, cols]), pa.array(best.products[rows, cols])], names)

    tiles = left.groupBy("bin", "part").cogroup(right.groupBy("bin", "part"))
    return tiles.applyInArrow(meet, "q long, vec_id long, score double")
