"""Attribution: which features moved a score, per applicant and overall."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions.numbers import exact_mean
from ..functions.text import display_name
from .score import DELAY_SCORECARD, Scorecard


def feature_means(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row of means."""
    return df.agg(*[exact_mean(F.col(c)).alias(c) for c in names])


def linear_contributions(
    df: DataFrame, card: Scorecard = DELAY_SCORECARD, means: Mapping[str, float] | None = None, digits: int = 6
) -> DataFrame:
    """Adds `contributions`, an array in feature order: weight * (value - mean).

    The means come from the table itself unless they were fixed before, as for a
    stream or a single applicant.
    """
    weighted = [c for c in card.features if c in card.weights]
    if means is None:
        row = feature_means(df, weighted).select(F.struct("*")).scalar()
        df, center = df.withColumn("_means", row), lambda c: F.col(f"_means.{c}")
    else:
        center = lambda c: F.lit(float(means[c]))

    def impact(c: str) -> Column:
        if c not in card.weights:
            return F.lit(0.0)
        return F.round(F.lit(float(card.weights[c])) * (F.col(c) - center(c)), digits)

    entries = [
        F.struct(F.lit(c).alias("feature"), impact(c).alias("impact"), F.col(c).cast("double").alias("value"))
        for c in card.features
    ]
    return df.withColumn("contributions", F.array(*entries)).drop("_means")


def top_factors(contributions: Column, k: int = X.TOP_SERVING) -> Column:
    """The k strongest entries, strongest first; ties keep feature order."""
    keyed = F.transform(contributions, lambda c, at: F.struct(
        (-F.abs(c["impact"])).alias("strength"), at.alias("at"), c.alias("entry")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda e: e["entry"])


def factor_rows(df: DataFrame, factors: Column) -> DataFrame:
    """(applicant, rank, feature, impact, value) rows."""
    return df.select(X.KEY, F.posexplode(factors).alias("at", "f")).select(
        X.KEY, (F.col("at") + 1).alias("rank"), "f.feature", "f.impact", "f.value")


def contribution_rows(df: DataFrame, share: float | None = None, seed: int = X.SEED) -> DataFrame:
    """Every (applicant, feature, value, impact) point, or a random share of the applicants."""
    chosen = df if share is None else df.sample(fraction=share, seed=seed)
    return chosen.select(X.KEY, F.inline("contributions"))


def global_importance(df: DataFrame, features: Sequence[str] = X.FEATURE_COLUMNS, k: int = X.TOP_GLOBAL) -> DataFrame:
    """Mean absolute impact per feature, ranked. One aggregate; rows are not exploded."""
    means = df.agg(*[
        exact_mean(F.abs(F.col("contributions")[at]["impact"])).alias(name) for at, name in enumerate(features)
    ])
    entries = F.array(*[
        F.struct((-F.round(name, 6)).alias("order"), F.lit(at).alias("at"), F.lit(name).alias("feature"))
        for at, name in enumerate(features)
    ])
    ranked = means.select(F.posexplode(F.slice(F.array_sort(entries), 1, k)).alias("at", "e"))
    return ranked.select(
        (F.col("at") + 1).alias("rank"), F.col("e.feature").alias("feature"),
        display_name(F.col("e.feature")).alias("display_name"),
        F.abs(F.col("e.order")).alias("mean_abs_impact"),
    )


def category_impact(df: DataFrame, categories: Mapping[str, Sequence[str]] = X.FEATURE_CATEGORIES) -> DataFrame:
    """Summed impact per applicant and feature group; a group without hits is 0."""

    def total(members: Sequence[str]) -> Column:
        hits = F.filter("contributions", lambda c: c["feature"].isin(list(members)))
        return F.round(F.aggregate(hits, F.lit(0.0), lambda acc, c: acc + c["impact"]), 6)

    rows = [F.struct(F.lit(name).alias("category"), total(members).alias("impact"))
            for name, members in categories.items()]
    return df.select(X.KEY, F.inline(F.array(*rows)))


def extremes(df: DataFrame, score: str = "risk_probability") -> DataFrame:
    """Riskiest and safest applicant; the lowest key wins a tie."""
    row = F.struct(X.KEY, score)
    one_row = df.agg(
        F.max_by(row, F.struct(score, -F.col(X.KEY))).alias("riskiest"),
        F.min_by(row, F.struct(score, X.KEY)).alias("safest"),
    )
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), f"{kind}.*") for kind in ("riskiest", "safest")
    ])))


def direction(impact: Column) -> Column:
    return F.when(impact > 0, X.RAISES).otherwise(X.LOWERS)
