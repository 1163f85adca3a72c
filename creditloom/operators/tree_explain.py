"""Exact feature contributions of a boosted-tree model.

Per leaf the score is a game over the few features on its path: a feature in the
coalition decides by its value, one outside by the share of training weight that
follows the path. Tasks get the node tables and work out the Shapley values per
Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed as X
from .. import schemas as S
from ..session import scratch_path

LOG_ODDS = 2.0  # Spark's probability is 1 / (1 + exp(-2 * margin))


@dataclass(frozen=True)
class Tree:
    """A node table, and its contributions for trees of any depth.

    With x the share of features that have joined, a leaf's Shapley values are
    integrals over x of a polynomial of degree m - 1, which Gauss-Legendre
    quadrature of (m + 1) / 2 points gives exactly: O(m * m) for a leaf and each
    different outcome of its tests. Nothing is tabulated and no term is negative.
    """

    left: np.ndarray  # children by place, -1 at a leaf
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray  # log-odds
    cover: np.ndarray  # training weight

    @property
    def bias(self) -> float:
        leaf = self.left < 0
        return float(self.value[leaf] @ self.cover[leaf] / self.cover[0])

    def add_to(self, out: np.ndarray, matrix: np.ndarray) -> None:
        for features, low, high, shares, value in self.paths():
            m = len(features)
            if not m:
                continue
            values = matrix[:, features]
            holds = (values > low) & (values <= high)
            _, first, which = np.unique(holds @ (1 << np.arange(m)), return_index=True, return_inverse=True)
            out[:, features] += (value * _shapley(holds[first].astype(float), shares))[which]

    def paths(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]]:
        """(features, low, high, shares, value) of every leaf: the bounds and weight shares along its path."""
        pending = [(0, {})]
        while pending:
            at, path = pending.pop()
            if self.left[at] < 0:
                features = sorted(path)
                low, high, shares = np.array([path[f] for f in features], dtype=float).reshape(-1, 3).T
                yield np.array(features, dtype=int), low, high, shares, float(self.value[at])
                continue
            feature, threshold = int(self.feature[at]), self.threshold[at]
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            for child, bounds in (
                (self.left[at], (low, min(high, threshold))), (self.right[at], (max(low, threshold), high)),
            ):
                follows = share * self.cover[child] / self.cover[at]
                pending.append((child, {**path, feature: (*bounds, follows)}))


def _shapley(holds: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """(rows, m) contributions of m tests to a leaf of value 1, by which of them hold."""
    m = holds.shape[1]
    points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
    out = np.zeros(holds.shape)
    for x, weight in zip((points + 1) / 2, weights / 2):
        factors = holds * x + shares * (1 - x)
        others = np.ones(holds.shape)
        others[:, 1:] = np.cumprod(factors[:, :-1], axis=1)
        others[:, :-1] *= np.cumprod(factors[:, :0:-1], axis=1)[:, ::-1]
        out += weight * others
    return out * (holds - shares)


def _tree(nodes: dict[int, dict], weight: float) -> Tree:
    place = {node: at for at, node in enumerate(sorted(nodes))}
    rows = [nodes[node] for node in sorted(nodes)]
    inner = [row["leftChild"] >= 0 for row in rows]
    if any(row["split"]["numCategories"] != -1 for row, splits in zip(rows, inner) if splits):
        raise ValueError("only numeric splits are supported")
    return Tree(
        np.array([place.get(row["leftChild"], -1) for row in rows]), np.array([place.get(row["rightChild"], -1) for row in rows]),
        np.array([row["split"]["featureIndex"] for row in rows]),
        np.array([row["split"]["leftCategoriesOrThreshold"][0] if splits else 0.0 for row, splits in zip(rows, inner)]),
        np.array([LOG_ODDS * weight * row["prediction"] for row in rows]), np.array([row["impurityStats"][0] for row in rows]))


def model_trees(model: PipelineModel) -> list[Tree]:
    """Read from the saved model: its size is that of the node table, whatever was scored."""
    gbt = model.stages[-1]
    spark = SparkSession.active()
    path = scratch_path(spark, "gbt")
    gbt.write().save(path)
    trees: dict[int, dict[int, dict]] = {}
    for row in spark.read.parquet(f"{path}/data").toLocalIterator():
        node = row["nodeData"].asDict(recursive=True)
        trees.setdefault(row["treeID"], {})[node["id"]] = node
    weights = gbt.treeWeights
    return [_tree(nodes, weights[tree]) for tree, nodes in sorted(trees.items())]


def contributions_of(matrix: np.ndarray, parts: list[Tree]) -> np.ndarray:
    """(rows, features) log-odds contributions."""
    out = np.zeros(matrix.shape)
    for part in parts:
        part.add_to(out, matrix)
    return out


def base_value(parts: list[Tree]) -> float:
    """Mean log-odds over the training weights: what a score starts from."""
    return float(sum(part.bias for part in parts))


def tree_contributions(df: DataFrame, parts: list[Tree], digits: int = 6) -> DataFrame:
    """Adds `base_value` and `contributions`; they sum to the log-odds of the score."""
    bias = base_value(parts)
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def impacts(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in values:
            matrix = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(X.FEATURE_COLUMNS))
            result = contributions_of(matrix, parts)
            offsets = np.arange(0, result.size + 1, matrix.shape[1], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(result.reshape(-1)))

    values = F.array(*[F.col(c).cast("double") for c in X.FEATURE_COLUMNS])
    names = F.array(*[F.lit(c) for c in X.FEATURE_COLUMNS])
    staged = df.withColumn("_impacts", impacts(values))
    entries = F.transform(F.arrays_zip(names.alias("f"), F.col("_impacts").alias("i"), values.alias("v")), lambda e: F.struct(
        e["f"].alias("feature"), F.round(e["i"], digits).alias("impact"), e["v"].alias("value")))
    return staged.withColumn("contributions", entries.cast(S.FACTORS)).withColumn(
        "base_value", F.round(F.lit(bias), digits)).drop("_impacts")
