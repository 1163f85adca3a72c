"""Recoding, validation, exposure caps and code labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed as X


def education(code: Column) -> Column:
    return F.when(code.isin(X.EDUCATION_UNDOCUMENTED), X.EDUCATION_OTHER).otherwise(code)


def marriage(code: Column) -> Column:
    return F.when(code.isin(X.MARRIAGE_UNDOCUMENTED), X.MARRIAGE_OTHER).otherwise(code)


def recode(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "EDUCATION": education(F.col("EDUCATION")),
        "MARRIAGE": marriage(F.col("MARRIAGE")),
    })


def _number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _outside(name: str, labels: dict[int, str]) -> Column:
    return F.col(name).isNull() | ~F.col(name).isin(list(labels))


def warnings() -> Column:
    """Messages for the raw values of one applicant; a missing number counts as 0."""
    rules = [
        (_number("LIMIT_BAL") <= 0, X.WARN_LIMIT),
        (~_number("AGE").between(*X.AGE_RANGE), X.WARN_AGE),
        (_outside("EDUCATION", X.EDUCATION_LABELS), X.WARN_EDUCATION),
        (_outside("MARRIAGE", X.MARRIAGE_LABELS), X.WARN_MARRIAGE),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.lit(message)) for broken, message in rules]))


def cap_flags(clean_cap: float = X.CLEAN_CAP, aggregate_cap: float = X.AGGREGATE_CAP) -> Column:
    limit = _number("LIMIT_BAL")
    return F.struct(
        (limit > clean_cap).alias(X.FLAG_CLEAN),
        (limit > aggregate_cap).alias(X.FLAG_AGGREGATE),
    )


def validate(df: DataFrame) -> DataFrame:
    return df.withColumns({"data_warnings": warnings(), "cap_flags": cap_flags()})


def limit_against_caps(
    df: DataFrame, clean_cap: float = X.CLEAN_CAP, aggregate_cap: float = X.AGGREGATE_CAP
) -> DataFrame:
    amounts = [F.col("LIMIT_BAL"), F.lit(float(clean_cap)), F.lit(float(aggregate_cap))]
    rows = [F.struct(F.lit(label).alias("label"), amount.alias("amount"))
            for label, amount in zip(X.CAP_LABELS, amounts)]
    return df.select(X.KEY, F.inline(F.array(*rows)))


def code_label(code: Column, labels: dict[int, str]) -> Column:
    """A handful of fixed codes: a literal map in the expression, no join."""
    table = F.create_map(*[F.lit(item) for pair in labels.items() for item in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit(X.UNKNOWN_LABEL))


def with_labels(df: DataFrame) -> DataFrame:
    labelled = df.withColumns({
        "sex_label": code_label(F.col("SEX"), X.SEX_LABELS),
        "education_label": code_label(F.col("EDUCATION"), X.EDUCATION_LABELS),
        "marriage_label": code_label(F.col("MARRIAGE"), X.MARRIAGE_LABELS),
    })
    age = F.coalesce(F.col("AGE").cast("string"), F.lit(X.UNKNOWN_LABEL))
    return labelled.withColumn(
        "summary_line",
        F.format_string("%s, %s years old, %s, %s", "sex_label", age, "education_label", "marriage_label"),
    )


def quality_rollup(df: DataFrame) -> DataFrame:
    """Warnings and cap breaches over the whole portfolio, one pass."""
    checked = validate(df)
    breaches = F.array(*[
        F.when(F.col(f"cap_flags.{flag}"), F.lit(flag)) for flag in (X.FLAG_CLEAN, X.FLAG_AGGREGATE)
    ])
    findings = F.concat(F.col("data_warnings"), F.array_compact(breaches))
    finding = F.explode_outer(findings).alias("finding")
    return (
        checked.select(finding)
        .groupBy(F.coalesce("finding", F.lit("None")).alias("finding"))
        .agg(F.count(F.lit(1)).alias("applicants"))
    )


def warning_counts(df: DataFrame) -> DataFrame:
    """Warnings per applicant and whether the clean cap is broken."""
    return validate(df).select(
        X.KEY,
        F.size("data_warnings").alias("n_warnings"),
        F.col(f"cap_flags.{X.FLAG_CLEAN}").alias("clean_cap_exceeded"),
    )
