"""Boosted trees with regularised leaves, trained from histograms of gradients.

A leaf of gradients G and curvatures H has the weight -T(G) / (H + l2) and is worth T(G)^2 / (H + l2) / 2, where T
moves G towards zero by l1; a split must be worth more than `gamma` beyond its parent, and each side must have a
curvature of `child_weight`. Rows are binned once by quantiles. For every level of a tree each task adds up G and H
per node, feature and bin; what the tasks found is added up per node, which also picks the split, so nothing but
splits comes to the driver: as many rows as a level has nodes.

Several models, such as the folds and trials of a search, are trained side by side: one pass over the rows serves a
level of all of them. Gradients are whole multiples of 2**-24, so sums are exact and a model does not depend on how
its rows were dealt out or which tasks ran twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed as X
from ..session import remove_scratch, scratch_path
from .tree_explain import Tree

BINS = 64
QUANTILE_ERROR = 10_000
UNIT = 2.0**24  # gradients are whole multiples of 1 / UNIT
WRITTEN_EVERY = 8  # trees after which the rows' scores are written
TOGETHER = 16  # models trained side by side
#: Of a histogram: gradient, curvature.
SIDES = 2


@dataclass(frozen=True)
class Params:
    """The nine ranges of a search, at what they are without one."""

    trees: int = 20
    depth: int = 5
    rate: float = 0.3
    subsample: float = 1.0
    columns: float = 1.0
    child_weight: float = 1.0
    gamma: float = 0.0
    l1: float = 0.0
    l2: float = 1.0
    seed: int = X.SEED


# --- A model ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Boosted:
    """Trees over named features; their sum is the score in log-odds."""

    features: tuple[str, ...]
    trees: tuple[Tree, ...]

    def margin(self, matrix: np.ndarray) -> np.ndarray:
        total = np.zeros(len(matrix))
        for tree in self.trees:
            total += tree.value[_routed(tree, matrix)]
        return total


def _routed(tree: Tree, matrix: np.ndarray) -> np.ndarray:
    """The leaf of every row. A leaf leads to itself, so all rows take as many steps as the tree has levels."""
    inner, own = tree.left >= 0, np.arange(len(tree.left))
    feature = np.where(inner, tree.feature, 0)
    children = np.column_stack([np.where(inner, tree.right, own), np.where(inner, tree.left, own)]).reshape(-1)
    flat, first = np.ascontiguousarray(matrix).reshape(-1), np.arange(len(matrix)) * matrix.shape[1]
    at, level = np.zeros(len(matrix), np.int64), np.zeros(1, np.int64)
    while inner[level].any():
        goes_left = flat.take(first + feature.take(at)) <= tree.threshold.take(at)
        at = children.take(2 * at + goes_left)
        level = np.unique(children.reshape(-1, 2)[level])
    return at


def probability(features: Column, models: Boosted | Sequence[Boosted], fold: Column | None = None, digits: int = 6) -> Column:
    """Of an array of the model's features, rounded before anything is compared with it; null where the array is null.

    With a list of models, each row is scored by the one at its `fold`.
    """
    several = [models] if isinstance(models, Boosted) else list(models)

    @F.arrow_udf("double")
    def margin(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch, which in batches:
            there, chosen = batch.is_valid().to_numpy(zero_copy_only=False), which.to_numpy(zero_copy_only=False)
            total = np.zeros(len(batch))
            matrix = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(several[0].features))
            found = np.zeros(len(matrix))
            for at, model in enumerate(several):
                mine = chosen[there] == at
                found[mine] = model.margin(matrix[mine])
            total[there] = found
            yield pa.array(total, mask=~there)

    own = F.lit(0) if fold is None else fold
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(features, own.cast("int")))), digits)


def feature_array(names: Sequence[str] = X.FEATURE_COLUMNS) -> Column:
    """Null for a row without one of its features."""
    values = [F.col(name).cast("double") for name in names]
    whole = F.forall(F.array(*values), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(whole, F.array(*values))


NODES = "tree int, node int, left int, right int, feature int, threshold double, value double, cover double"


def node_table(spark: SparkSession, model: Boosted) -> DataFrame:
    """One row per node: all there is to a model but the names of its features."""
    rows = [
        (at, node, *(kind(x[node]) for kind, x in zip(
            (int, int, int, float, float, float), (tree.left, tree.right, tree.feature, tree.threshold, tree.value, tree.cover))))
        for at, tree in enumerate(model.trees) for node in range(len(tree.left))]
    return spark.createDataFrame(rows, NODES)


def from_node_table(nodes: DataFrame, features: Sequence[str]) -> Boosted:
    trees: dict[int, list] = {}
    for row in nodes.orderBy("tree", "node").toLocalIterator():
        trees.setdefault(row["tree"], []).append(row)
    return Boosted(tuple(features), tuple(
        Tree(*[np.array([r[name] for r in rows]) for name in ("left", "right", "feature", "threshold", "value", "cover")])
        for _, rows in sorted(trees.items())))


# --- Bins ----------------------------------------------------------------------------------

def bin_edges(df: DataFrame, names: Sequence[str] = X.FEATURE_COLUMNS, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the values to split at, `bins` - 1 at most: its quantiles, or all values of one that has few. One scan."""
    shares = F.array(*[F.lit(at / bins) for at in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, QUANTILE_ERROR).alias(f"q{at}") for at, c in enumerate(names)],
                 *[F.max(F.col(c).cast("double")).alias(f"m{at}") for at, c in enumerate(names)]).first()
    found = []
    for at in range(len(names)):
        values = np.unique(np.array(row[f"q{at}"] or [], float))
        found.append(values[values < row[f"m{at}"]] if len(values) else values)
    return found


def _binned(matrix: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin b holds what is above edge b - 1 and not above edge b."""
    return np.column_stack([np.searchsorted(e, matrix[:, at], side="left") for at, e in enumerate(edges)]).astype(np.uint8)


# --- Training --------------------------------------------------------------------------------

@dataclass
class _Growing:
    """A model in training: the tree that grows now, in bins, and those the written scores do not have yet."""

    params: Params
    fold: int | None  # rows of this fold are not learnt from
    done: list[Tree] = field(default_factory=list)
    pending: list[Tree] = field(default_factory=list)
    nodes: list[list] = field(default_factory=list)  # left, right, feature, bin, gradient, curvature
    open: list[int] = field(default_factory=list)  # nodes of the level to be split now
    columns: np.ndarray | None = None

    @property
    def finished(self) -> bool:
        return len(self.done) >= self.params.trees

    def plant(self, n_features: int) -> None:
        rng = np.random.default_rng([self.params.seed, len(self.done)])
        many = max(1, round(self.params.columns * n_features))
        self.columns = np.sort(rng.choice(n_features, many, replace=False))
        self.nodes, self.open = [[-1, -1, -1, -1, 0.0, 0.0]], [0]

    def split(self, node: int, found: dict) -> None:
        """`found`: sums of the node, and its best split if it has one."""
        self.nodes[node][4:] = [found["g"], found["h"]]
        if found["feature"] < 0:
            return
        left, right = len(self.nodes), len(self.nodes) + 1
        self.nodes[node][:4] = [left, right, found["feature"], found["bin"]]
        self.nodes += [[-1, -1, -1, -1, found["gl"], found["hl"]], [-1, -1, -1, -1, found["g"] - found["gl"], found["h"] - found["hl"]]]

    def partial(self) -> Tree:
        """The tree as it is, over bins."""
        left, right, feature, at, g, h = map(np.array, zip(*self.nodes))
        weight = np.where(left < 0, -self.params.rate * _shrunk(g, self.params.l1) / np.maximum(h + self.params.l2, 1e-12), 0.0)
        return Tree(left, right, feature, at.astype(float), weight, np.maximum(h, 1e-12))


def _shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _draw(row_hash: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in 0..1 per row and tree."""
    mixed = (row_hash.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xBF58476D1CE4E5B9) % 2**64))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(11)).astype(float) / 2.0**53


def _best_split(hist: np.ndarray, params: Params, columns: np.ndarray) -> dict:
    """The best split of a node by its (side, feature, bin) sums; the first feature and bin win a tie."""
    g, h = hist[:, 0].sum(axis=1) / UNIT
    out = {"g": float(g), "h": float(h), "feature": -1, "bin": -1, "gl": 0.0, "hl": 0.0, "gain": 0.0}
    left = np.cumsum(hist[:, columns], axis=2)[:, :, :-1] / UNIT
    gl, hl = left
    gr, hr = g - gl, h - hl

    def worth(a, b):
        return _shrunk(a, params.l1) ** 2 / np.maximum(b + params.l2, 1e-12)

    gain = 0.5 * (worth(gl, hl) + worth(gr, hr) - worth(g, h)) - params.gamma
    gain = np.where((hl >= params.child_weight) & (hr >= params.child_weight) & (hl > 0) & (hr > 0), gain, -np.inf)
    if gain.size and gain.max() > 1e-9:
        feature, at = np.unravel_index(gain.argmax(), gain.shape)
        out |= {"feature": int(columns[feature]), "bin": int(at), "gl": float(gl[feature, at]), "hl": float(hl[feature, at]),
                "gain": float(gain[feature, at])}
    return out


class _Rows:
    """The binned rows below the shared folder, with every model's score so far."""

    SCHEMA = "bins binary, label double, weight double, fold int, hash long, scores binary"

    def __init__(self, df: DataFrame, edges: list[np.ndarray], models: list[_Growing], names: Sequence[str], label: str, weight: str | None, key: str, fold: str | None):
        self.spark, self.models, self.edges = df.sparkSession, models, edges
        self.bins = max(len(e) for e in edges) + 1
        missing = F.raise_error(F.lit("a row without one of its features, or without a label"))
        kept = df.select(
            F.coalesce(feature_array(names), missing.cast("array<double>")).alias("x"),
            F.coalesce(F.col(label).cast("double"), missing.cast("double")).alias("label"),
            (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"),
            (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"), F.xxhash64(key).alias("hash"))
        blank = np.zeros(len(models)).tobytes()

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matrix = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(edges))
                yield pa.RecordBatch.from_arrays(
                    [_fixed(_binned(matrix, edges)), *[batch[c] for c in ("label", "weight", "fold", "hash")], pa.array([blank] * len(batch), pa.binary())],
                    ["bins", "label", "weight", "fold", "hash", "scores"])

        self.path = scratch_path(self.spark, "boosting")
        kept.mapInArrow(binned, self.SCHEMA).write.parquet(self.path)

    @property
    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def write_scores(self) -> None:
        """Adds the pending trees to the written scores; the table before is removed."""
        trees = [m.pending for m in self.models]

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = _scores(batch, trees)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _fixed(scores)], batch.schema.names)

        before, self.path = self.path, scratch_path(self.spark, "boosting")
        self.spark.read.schema(self.SCHEMA).parquet(before).mapInArrow(scored, self.SCHEMA).write.parquet(self.path)
        remove_scratch(self.spark, before)
        for model in self.models:
            model.pending = []

    def level(self) -> list[dict]:
        """The best split of every open node of every model."""
        growing = [(at, m.params, m.fold, len(m.done), m.pending, m.partial(), m.open) for at, m in enumerate(self.models) if m.open]
        n_features, bins = len(self.edges), self.bins

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {at: np.zeros((len(open_nodes), SIDES, n_features, bins)) for at, *_, open_nodes in growing}
            for batch in batches:
                matrix, scores = _unfixed(batch["bins"], np.uint8), _unfixed(batch["scores"], np.float64)
                label, weight, fold, drawn = (batch[c].to_numpy(zero_copy_only=False) for c in ("label", "weight", "fold", "hash"))
                cells = matrix + bins * np.arange(n_features)
                for at, params, left_out, tree_number, pending, tree, open_nodes in growing:
                    slot_of = np.full(len(tree.left), -1)
                    slot_of[open_nodes] = np.arange(len(open_nodes))
                    slot = slot_of[_routed(tree, matrix)]
                    counts = slot >= 0
                    if left_out is not None:
                        counts &= fold != left_out
                    if params.subsample < 1:
                        counts &= _draw(drawn, params.seed, tree_number) < params.subsample
                    mine = np.flatnonzero(counts)
                    if not len(mine):
                        continue
                    rows = matrix[mine]
                    margin = scores[mine, at] + sum((t.value[_routed(t, rows)] for t in pending), 0.0)
                    p = 1.0 / (1.0 + np.exp(-margin))
                    where = (slot[mine, None] * (n_features * bins) + cells[mine]).reshape(-1)
                    for side, value in enumerate((weight[mine] * (p - label[mine]), weight[mine] * p * (1.0 - p))):
                        whole = np.repeat(np.rint(value * UNIT), n_features)
                        held[at][:, side] += np.bincount(where, whole, minlength=len(open_nodes) * n_features * bins).reshape(-1, n_features, bins)
            for at, *_, open_nodes in growing:
                yield pa.RecordBatch.from_arrays([
                    pa.array([at] * len(open_nodes), pa.int32()), pa.array(open_nodes, pa.int32()),
                    pa.array([held[at][slot].astype(np.int64).tobytes() for slot in range(len(open_nodes))], pa.binary())], ["model", "node", "sums"])

        columns = {at: (m.params, m.columns) for at, m in enumerate(self.models)}

        def choose(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((SIDES, n_features, bins), np.int64)
            for part in parts:
                for packed in part["sums"]:
                    total += np.frombuffer(packed.as_buffer(), np.int64).reshape(total.shape)
            model, node = (k.as_py() for k in key)
            found = _best_split(total, *columns[model])
            yield pa.RecordBatch.from_pylist([{"model": model, "node": node, **found}], schema=split_schema)

        split_schema = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("g", pa.float64()), ("h", pa.float64()), ("feature", pa.int32()),
                                  ("bin", pa.int32()), ("gl", pa.float64()), ("hl", pa.float64()), ("gain", pa.float64())])
        tasks = self.table.mapInArrow(sums, "model int, node int, sums binary")
        return tasks.groupBy("model", "node").applyInArrow(
            choose, "model int, node int, g double, h double, feature int, bin int, gl double, hl double, gain double").toArrow().to_pylist()


def _fixed(matrix: np.ndarray) -> pa.Array:
    """A binary value per row of a matrix."""
    size = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(0, size * len(matrix) + 1, size, dtype=np.int32) if size else np.zeros(len(matrix) + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def _unfixed(column: pa.Array, kind) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data.view(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def _scores(batch: pa.RecordBatch, trees: list[list[Tree]]) -> np.ndarray:
    matrix = _unfixed(batch["bins"], np.uint8)
    scores = _unfixed(batch["scores"], np.float64).copy()
    for at, added in enumerate(trees):
        for tree in added:
            scores[:, at] += tree.value[_routed(tree, matrix)]
    return scores


def _in_values(tree: Tree, edges: Sequence[np.ndarray]) -> Tree:
    """A tree over bins as a tree over values."""
    threshold = [edges[f][int(t)] if f >= 0 else 0.0 for f, t in zip(tree.feature, tree.threshold)]
    return replace(tree, threshold=np.array(threshold, float), feature=np.maximum(tree.feature, 0))


def train_together(
    df: DataFrame, models: Sequence[tuple[Params, int | None]], *, names: Sequence[str] = X.FEATURE_COLUMNS, label: str = X.TARGET,
    weight: str | None = None, key: str = X.KEY, fold: str | None = None, bins: int = BINS, edges: list[np.ndarray] | None = None,
) -> list[Boosted]:
    """One model per (parameters, fold to leave out or None).

    `weight` names a column of row weights, `fold` the column of folds, `key` the one that sampling hashes. Rows
    need a label and all features. A table without rows gives models without trees. At most TOGETHER models share a
    pass; memory of a task is that of their histograms: models x nodes of a level x features x bins.
    """
    edges = bin_edges(df, names, bins) if edges is None else edges
    out: list[Boosted] = []
    for start in range(0, len(models), TOGETHER):
        growing = [_Growing(params, left_out) for params, left_out in models[start:start + TOGETHER]]
        rows = _Rows(df, edges, growing, names, label, weight, key, fold)
        while not all(m.finished for m in growing):
            _grow(rows, growing)
        remove_scratch(rows.spark, rows.path)
        out += [Boosted(tuple(names), tuple(_in_values(t, edges) for t in m.done)) for m in growing]
    return out


def _grow(rows: _Rows, models: list[_Growing]) -> None:
    """One more tree for each model that needs one."""
    active = [m for m in models if not m.finished]
    for model in active:
        model.plant(len(rows.edges))
    level = 0
    while any(m.open for m in active):
        for model in active:
            if level >= max(1, model.params.depth):
                model.open = []
        if not any(m.open for m in active):
            break
        after: dict[int, list[int]] = {}
        for found in sorted(rows.level(), key=lambda r: (r["model"], r["node"])):
            model = models[found["model"]]
            first = len(model.nodes)
            model.split(found["node"], found)
            after.setdefault(found["model"], []).extend(range(first, len(model.nodes)))
        for at, model in enumerate(models):
            model.open = after.get(at, [])
        level += 1
    for model in active:
        tree = model.partial()
        model.done.append(tree)
        model.pending.append(tree)
        model.open = []
    if any(len(m.pending) >= WRITTEN_EVERY for m in models) and not all(m.finished for m in models):
        rows.write_scores()


def train(df: DataFrame, params: Params = Params(), **columns) -> Boosted:
    return train_together(df, [(params, None)], **columns)[0]
