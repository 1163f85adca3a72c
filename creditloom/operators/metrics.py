"""Threshold sweeps and classification metrics, each one pass over the scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions.numbers import ratio
from ..functions.running import sum_below

SCORE = "risk_probability"


def sweep_thresholds() -> list[float]:
    """Exact hundredths; adding steps of 0.01 would drift."""
    first, last = X.SWEEP_PERCENT
    return [percent / 100 for percent in range(first, last + 1)]


def _quality(tp: Column, fp: Column, fn: Column, tn: Column, digits: int = 6) -> dict[str, Column]:
    return {
        "accuracy": F.round(ratio(tp + tn, tp + fp + fn + tn), digits),
        "precision": F.round(ratio(tp, tp + fp), digits),
        "recall": F.round(ratio(tp, tp + fn), digits),
        "f1_score": F.round(ratio(2 * tp, 2 * tp + fp + fn), digits),
    }


def checked(df: DataFrame, score: str, label: str) -> DataFrame:
    """`df`, failing at a row whose score is null or NaN or whose label is null: no count may leave it out."""
    missing = F.col(score).isNull() | F.isnan(F.col(score).cast("double")) | F.col(label).isNull()
    refused = F.raise_error(F.lit("a row without a score or a label")).cast(df.schema[score].dataType)
    return df.withColumn(score, F.when(missing, refused).otherwise(F.col(score)))


def threshold_sweep(
    df: DataFrame, thresholds: Sequence[float], score: str = SCORE, label: str = X.TARGET
) -> DataFrame:
    """Confusion counts and metrics at every threshold.

    A row is counted once, under the number of thresholds its score reaches; the
    counts (one per threshold) are then summed up. Data is never multiplied by
    the number of thresholds.
    """
    ordered = sorted(thresholds)
    reached = sum((F.col(score) >= F.lit(float(t))).cast("int") for t in ordered)
    counts = checked(df, score, label).groupBy(reached.alias("reached")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    # At most len(thresholds) + 1 entries from here on.
    steps = counts.agg(F.collect_list(F.struct("reached", "pos", "neg")).alias("steps"))
    wanted = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(float(t)).alias("threshold"))
                       for i, t in enumerate(ordered, 1)])
    rows = steps.select("steps", F.inline(wanted))

    def total(kind: str, passed: bool) -> Column:
        def chosen(step: Column) -> Column:
            return step["reached"] >= F.col("at") if passed else step["reached"] < F.col("at")

        return F.aggregate(F.filter("steps", chosen), F.lit(0).cast("long"), lambda acc, step: acc + step[kind])

    cells = rows.select(
        "threshold",
        total("pos", True).alias("tp"), total("neg", True).alias("fp"),
        total("pos", False).alias("fn"), total("neg", False).alias("tn"),
    )
    return cells.withColumns(_quality(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def best_threshold(df: DataFrame, score: str = SCORE, label: str = X.TARGET) -> DataFrame:
    """Highest F1, the lowest threshold wins a tie; the fallback when F1 is 0 everywhere."""
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    best = (
        threshold_sweep(df, sweep_thresholds(), score, label)
        .agg(F.max_by(F.struct("threshold", "f1_score"), F.struct(f1, -F.col("threshold"))).alias("best"))
    )
    found = F.coalesce(F.col("best.f1_score"), F.lit(0.0)) > 0
    return best.select(
        F.when(found, F.col("best.threshold")).otherwise(F.lit(X.FALLBACK_THRESHOLD)).alias("threshold"),
        F.when(found, F.col("best.f1_score")).otherwise(F.lit(0.0)).alias("f1_score"),
    )


def threshold_table(
    df: DataFrame, current: float = X.DEFAULT_THRESHOLD, thresholds: Sequence[float] = X.TABLE_THRESHOLDS,
    score: str = SCORE, label: str = X.TARGET,
) -> DataFrame:
    table = threshold_sweep(df, thresholds, score, label)
    return table.select(
        "threshold", *[F.round(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")],
        (F.abs(F.col("threshold") - F.lit(current)) < X.CURRENT_TOLERANCE).alias("is_current"),
    )


def confusion_matrix(
    df: DataFrame, threshold: float = X.DEFAULT_THRESHOLD, score: str = SCORE, label: str = X.TARGET
) -> DataFrame:
    """Always four cells, also when one is empty."""
    df = checked(df, score, label)
    predicted = F.col(score) >= F.lit(float(threshold))
    cells = [(actual, guess) for actual in (0, 1) for guess in (0, 1)]
    one_row = df.agg(*[
        F.count_if((F.col(label) == actual) & (predicted == F.lit(bool(guess)))).alias(f"c{actual}{guess}")
        for actual, guess in cells
    ])
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(actual).alias("actual"), F.lit(guess).alias("predicted"), F.col(f"c{actual}{guess}").alias("n"))
        for actual, guess in cells
    ])))


def _ranked_scores(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, score, pos, neg, neg_below): class counts per distinct score and the negatives of its group below it.

    Rows are grouped by score first. Distinct scores are dealt out by ranges, so
    that no single task sees all of them, whatever their range is.
    """
    by_score = checked(df, score, label).groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ranked = sum_below(by_score, [*by, "score"], "neg", "neg_below")
    if not by:
        return ranked
    first = ranked.groupBy(*by).agg(F.min("neg_below").alias("_first"))  # one row per group
    return ranked.join(first, list(by)).withColumn("neg_below", F.col("neg_below") - F.col("_first")).drop("_first")


def _auc() -> Column:
    """Aggregate over ranked scores; ties count half."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    # In half units every term is a whole number, so the sum is exact.
    doubled = (pos * (2 * F.col("neg_below").cast("double") + neg)).cast("decimal(38,0)")
    pairs = 2 * F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return F.round(F.try_divide(F.sum(doubled).cast("double"), pairs), 6)


def roc_auc(
    df: DataFrame, score: str = SCORE, label: str = X.TARGET, by: Sequence[str] = (), counts: bool = False,
) -> DataFrame:
    """Area under the ROC curve, one row, or one for each group of the columns `by`; with the rows of each class if wanted."""
    classes = [F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")] if counts else []
    return _ranked_scores(df, score, label, by).groupBy(*by).agg(_auc().alias("roc_auc"), *classes)


def naive_baseline(df: DataFrame, label: str = X.TARGET) -> DataFrame:
    """Accuracy of always answering the largest class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.round(F.max("n") / F.sum("n"), 6).alias("naive_baseline"))


def classification_metrics(
    df: DataFrame, threshold: float = X.DEFAULT_THRESHOLD, score: str = SCORE, label: str = X.TARGET
) -> DataFrame:
    """One record: accuracy, precision, recall, F1, AUC and the naive baseline, in one pass."""
    passed = F.col("score") >= F.lit(float(threshold))

    def total(kind: str, reached: Column) -> Column:
        return F.coalesce(F.sum(F.when(reached, F.col(kind))), F.lit(0))

    cells = {"tp": total("pos", passed), "fp": total("neg", passed),
             "fn": total("pos", ~passed), "tn": total("neg", ~passed)}
    one_row = _ranked_scores(df, score, label).agg(
        *[cell.alias(name) for name, cell in cells.items()], _auc().alias("roc_auc"))
    tp, fp, fn, tn = (F.col(name) for name in cells)
    quality = {name: value.alias(name) for name, value in _quality(tp, fp, fn, tn).items()}
    naive = F.round(ratio(F.greatest(tp + fn, fp + tn), tp + fp + fn + tn), 6)
    return one_row.select(*quality.values(), "roc_auc", naive.alias("naive_baseline"))
