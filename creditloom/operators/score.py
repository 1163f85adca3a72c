"""Scoring and decisions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed as X


@dataclass(frozen=True)
class Scorecard:
    """A linear score in log-odds; feature order is the order of addition."""

    weights: Mapping[str, float]
    intercept: float
    digits: int = 6
    threshold: float = X.DEFAULT_THRESHOLD
    features: tuple[str, ...] = field(default_factory=lambda: tuple(X.FEATURE_COLUMNS))

    def margin(self) -> Column:
        total = None
        for name, weight in self.weights.items():
            term = F.lit(float(weight)) * F.col(name)
            total = term if total is None else total + term
        return total + F.lit(float(self.intercept))

    def probability(self) -> Column:
        # Rounded before any comparison, so that ties and thresholds are stable.
        return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin())), self.digits)


DELAY_SCORECARD = Scorecard(
    weights={"avg_pay_delay": 0.5, "months_late": 0.2, "payment_ratio": -1.0, "utilization_ratio": -0.05},
    intercept=-3.2,
)


def decision(probability: Column, threshold: float) -> Column:
    return F.when(probability >= F.lit(float(threshold)), X.REJECT).otherwise(X.APPROVE)


def score(df: DataFrame, card: Scorecard = DELAY_SCORECARD) -> DataFrame:
    return df.withColumn("risk_probability", card.probability()).withColumn(
        "risk_decision", decision(F.col("risk_probability"), card.threshold))
