"""Default-risk model on Spark ML: training, search, out-of-fold scores, bundles."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed as X
from ..session import materialize
from .score import decision
from .split import class_weight, stratified_folds

VECTOR, WEIGHT, FOLD = "features", "weight", "fold"


def with_class_weight(df: DataFrame, label: str = X.TARGET) -> DataFrame:
    """Defaulters weigh negatives / positives, everyone else 1."""
    weight = class_weight(df, label).select("scale_pos_weight").scalar()
    return df.withColumn(WEIGHT, F.when(F.col(label) == 1, F.coalesce(weight, F.lit(1.0))).otherwise(1.0))


def classifier(**params) -> GBTClassifier:
    return GBTClassifier(
        featuresCol=VECTOR, labelCol=X.TARGET, weightCol=WEIGHT, seed=X.SEED, lossType="logistic", **params)


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=X.FEATURE_COLUMNS, outputCol=VECTOR, handleInvalid="error")


def train(df: DataFrame, **params) -> PipelineModel:
    """Boosted trees with class weights on a feature table."""
    return Pipeline(stages=[assembler(), classifier(**params)]).fit(with_class_weight(df))


def random_trials(
    gbt: GBTClassifier, n: int = X.TRIALS, seed: int = X.SEED,
    trees: tuple[int, int] = X.SEARCH_TREES, depth: tuple[int, int] = X.SEARCH_DEPTH,
) -> list[dict]:
    """Seeded random parameter maps over the ranges Spark's boosted trees share with the scheme."""
    rng = random.Random(seed)
    low, high = X.SEARCH_RATE
    return [
        {
            gbt.maxIter: rng.randint(*trees),
            gbt.maxDepth: rng.randint(*depth),
            gbt.stepSize: low * (high / low) ** rng.random(),
            gbt.subsamplingRate: rng.uniform(*X.SEARCH_SUBSAMPLE),
            gbt.featureSubsetStrategy: str(round(rng.uniform(*X.SEARCH_COLUMN_SAMPLE), 4)),
            gbt.minInstancesPerNode: rng.randint(*X.SEARCH_MIN_CHILD),
            gbt.minInfoGain: rng.uniform(*X.SEARCH_MIN_GAIN) / 100,
        }
        for _ in range(n)
    ]


def search(
    df: DataFrame, n: int = X.TRIALS, k: int = X.FOLDS, seed: int = X.SEED, parallelism: int = 4, **ranges
) -> tuple[CrossValidatorModel, list[dict]]:
    """Mean AUC over k stratified folds for every random parameter map; keeps the best."""
    # Boosting reads its input for every tree: write it once.
    folded = materialize(assembler().transform(stratified_folds(with_class_weight(df), k=k, seed=seed)), "folds")
    gbt = classifier()
    trials = random_trials(gbt, n, seed, **ranges)
    validator = CrossValidator(
        estimator=gbt, estimatorParamMaps=trials, numFolds=k, foldCol=FOLD, parallelism=parallelism, seed=seed,
        evaluator=BinaryClassificationEvaluator(labelCol=X.TARGET, numBins=0),
    )
    return validator.fit(folded), trials


def search_report(spark: SparkSession, model: CrossValidatorModel, trials: list[dict]) -> DataFrame:
    """One row per trial: parameters and mean AUC. As long as the number of trials."""
    rows = [
        (at, {param.name: str(value) for param, value in trial.items()}, float(auc))
        for at, (trial, auc) in enumerate(zip(trials, model.avgMetrics))
    ]
    return spark.createDataFrame(rows, "trial int, params map<string,string>, mean_auc double")


def predict(model: PipelineModel, df: DataFrame, threshold: float = X.DEFAULT_THRESHOLD) -> DataFrame:
    probability = F.round(vector_to_array("probability")[1], 6)
    scored = model.transform(df).withColumn("risk_probability", probability)
    return scored.withColumn("risk_decision", decision(F.col("risk_probability"), threshold)).select(
        *df.columns, "risk_probability", "risk_decision")


def out_of_fold(df: DataFrame, k: int = X.FOLDS, seed: int = X.SEED, **params) -> DataFrame:
    """Every row scored by the model that did not see its fold."""
    folded = materialize(stratified_folds(df, k=k, seed=seed), "folds")
    parts = []
    for fold in range(k):
        model = train(folded.filter(F.col(FOLD) != fold), **params)
        parts.append(predict(model, folded.filter(F.col(FOLD) == fold)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def save_bundle(model: PipelineModel, threshold: float, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    set_threshold(SparkSession.active(), threshold, path, version=0)


def set_threshold(spark: SparkSession, threshold: float, path: str, version: int | None = None) -> None:
    """Append a new threshold; the model stays as it is."""
    if version is None:
        version = current_threshold(spark, path)[0] + 1
    row = spark.createDataFrame([(version, float(threshold))], "version int, threshold double")
    row.coalesce(1).write.mode("append").parquet(f"{path}/threshold")


def current_threshold(spark: SparkSession, path: str) -> tuple[int, float]:
    """One row: the latest version."""
    log = spark.read.schema("version int, threshold double").parquet(f"{path}/threshold")
    row = log.agg(F.max(F.struct("version", "threshold")).alias("latest")).select("latest.*").first()
    return row["version"], row["threshold"]


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, float]:
    return PipelineModel.load(f"{path}/model"), current_threshold(spark, path)[1]
