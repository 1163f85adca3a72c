"""Numeric expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money and ratios are summed as decimals: the result does not depend on the
# order in which partitions arrive.
EXACT = "decimal(24,6)"


def months_total(columns: Sequence[str]) -> Column:
    """The months of a history added up; a month that is missing leaves the total open."""
    return F.expr(" + ".join(f"`{c}`" for c in columns))


def exact_mean(value: Column) -> Column:
    return F.try_divide(F.sum(value.cast(EXACT)).cast("double"), F.count(value))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part, whole) * 100, digits)


def ratio(part: Column, whole: Column) -> Column:
    """0 where the ratio is undefined."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
