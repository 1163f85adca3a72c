"""Boosted trees in use: search over all nine ranges, scores out of fold, bundles, scoring and attribution."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed as X
from ..session import materialize
from . import metrics
from .boosting import Boosted, Params, bin_edges, feature_array, from_node_table, node_table, probability, train_together
from .model import FOLD, WEIGHT, current_threshold, set_threshold
from .score import decision
from .split import stratified_folds
from .tree_explain import base_value, tree_contributions

SCORE = metrics.SCORE


# --- Search -------------------------------------------------------------------------------

def random_params(
    n: int = X.TRIALS, seed: int = X.SEED, trees: tuple[int, int] = X.SEARCH_TREES, depth: tuple[int, int] = X.SEARCH_DEPTH,
) -> list[Params]:
    """Seeded random points of the nine ranges."""
    rng = random.Random(seed)
    low, high = X.SEARCH_RATE
    return [
        Params(
            trees=rng.randint(*trees), depth=rng.randint(*depth), rate=low * (high / low) ** rng.random(),
            subsample=rng.uniform(*X.SEARCH_SUBSAMPLE), columns=rng.uniform(*X.SEARCH_COLUMN_SAMPLE),
            child_weight=rng.uniform(*X.SEARCH_MIN_CHILD), gamma=rng.uniform(*X.SEARCH_MIN_GAIN),
            l1=rng.uniform(*X.SEARCH_L1), l2=rng.uniform(*X.SEARCH_L2), seed=seed)
        for _ in range(n)
    ]


@dataclass(frozen=True)
class Searched:
    best: Params
    trials: list[Params]
    aucs: DataFrame  # (trial, fold, roc_auc, positives, negatives)

    def report(self) -> DataFrame:
        """One row per trial: parameters and mean AUC."""
        spark = self.aucs.sparkSession
        rows = [(at, {name: str(value) for name, value in asdict(p).items() if name != "seed"}) for at, p in enumerate(self.trials)]
        means = self.aucs.groupBy("trial").agg(F.round(F.avg("roc_auc"), 6).alias("mean_auc"))
        return spark.createDataFrame(rows, "trial int, params map<string,string>").join(means, "trial")


def _scored_by_trial(folded: DataFrame, models: list[list[Boosted]], names: Sequence[str], label: str) -> DataFrame:
    """(trial, fold, label, score): every row scored by each trial's model that has not seen its fold."""
    rows = folded.select(F.col(label).cast("int").alias("label"), F.col(FOLD).alias("fold"), feature_array(names).alias("x"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch["fold"].to_numpy(zero_copy_only=False)
            matrix = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
            for trial, by_fold in enumerate(models):
                for at, model in enumerate(by_fold):
                    mine = (fold == at).nonzero()[0]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([trial] * len(mine), pa.int32()), pa.array([at] * len(mine), pa.int32()),
                        batch["label"].take(pa.array(mine)), pa.array(model.margin(matrix[mine]))], ["trial", "fold", "label", "margin"])

    scored = rows.mapInArrow(score, "trial int, fold int, label int, margin double")
    return scored.select("trial", "fold", "label", F.round(1.0 / (1.0 + F.exp(-F.col("margin"))), 6).alias("score"))


def search(
    df: DataFrame, n: int = X.TRIALS, k: int = X.FOLDS, seed: int = X.SEED, *, names: Sequence[str] = X.FEATURE_COLUMNS,
    label: str = X.TARGET, key: str = X.KEY, **ranges,
) -> Searched:
    """Mean AUC over k stratified folds for every random point; the first best point wins.

    The table brings its row weights, worked out once for all folds. All folds of
    all trials are trained side by side, so a pass over the rows serves a level of
    many models, and scored in one pass.
    """
    folded = materialize(stratified_folds(df, label, key, k, seed), "folds")
    edges = bin_edges(folded, names)
    trials = random_params(n, seed, **ranges)
    trained = train_together(
        folded, [(params, fold) for params in trials for fold in range(k)], names=names, label=label, weight=WEIGHT, key=key, fold=FOLD, edges=edges)
    models = [trained[at:at + k] for at in range(0, len(trained), k)]
    scored = _scored_by_trial(folded, models, names, label)
    aucs = materialize(metrics.roc_auc(scored, "score", "label", by=["trial", "fold"], counts=True), "aucs")
    best = aucs.groupBy("trial").agg(F.avg("roc_auc").alias("auc")).orderBy(F.desc_nulls_last("auc"), "trial").first()
    return Searched(trials[best["trial"]], trials, aucs)


def out_of_fold(
    df: DataFrame, params: Params = Params(), k: int = X.FOLDS, seed: int = X.SEED, *, names: Sequence[str] = X.FEATURE_COLUMNS,
    label: str = X.TARGET, key: str = X.KEY,
) -> DataFrame:
    """Adds `fold` and `risk_probability`: every row scored by the model that did not see its fold."""
    folded = materialize(stratified_folds(df, label, key, k, seed), "folds")
    models = train_together(folded, [(params, fold) for fold in range(k)], names=names, label=label, weight=WEIGHT, key=key, fold=FOLD)
    return folded.withColumn(SCORE, probability(feature_array(names), models, F.col(FOLD)))


# --- Bundles --------------------------------------------------------------------------------

@dataclass(frozen=True)
class Bundle:
    """A model and the threshold in force, with its version."""

    model: Boosted
    threshold: float
    version: int = 0


def save_bundle(spark: SparkSession, model: Boosted, threshold: float, path: str) -> None:
    """Node table, feature names and the first version of the threshold, below `path`."""
    nodes = node_table(spark, model).withColumn("features", F.lit(json.dumps(list(model.features))))
    nodes.coalesce(1).write.parquet(f"{path}/nodes")
    set_threshold(spark, threshold, path, version=0)


def latest_threshold(spark: SparkSession, path: str) -> dict:
    """The threshold in force, as fields of a bundle."""
    version, threshold = current_threshold(spark, path)
    return {"version": version, "threshold": threshold}


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    nodes = spark.read.parquet(f"{path}/nodes")
    names = json.loads(nodes.select("features").first()["features"])
    return Bundle(from_node_table(nodes, names), **latest_threshold(spark, path))


def score(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Adds `risk_probability` and `risk_decision`; both null where a feature is missing."""
    scored = df.withColumn(SCORE, probability(feature_array(bundle.model.features), bundle.model))
    return scored.withColumn("risk_decision", decision(F.col(SCORE), bundle.threshold)).withColumn(
        "risk_decision", F.when(F.col(SCORE).isNotNull(), F.col("risk_decision")))


def contributions(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Adds `base_value` and `contributions`, which sum to the log-odds; null where a feature is missing."""
    whole: Column = feature_array(bundle.model.features).isNotNull()
    explained = tree_contributions(df, list(bundle.model.trees))
    return explained.withColumn("contributions", F.when(whole, F.col("contributions")))


def model_base_value(bundle: Bundle) -> float:
    return base_value(list(bundle.model.trees))
