import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.operators import profile


@pytest.fixture(scope="module")
def skewed(spark):
    # `hot`: a third of the rows is one value. `wide`: a very uneven range. `gaps`: with nulls.
    return spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("hot"),
        F.pow(F.lit(1.01), F.col("id") % 1500).alias("wide"),
        F.when(F.col("id") % 4 > 0, (F.col("id") * 37 % 1009).cast("double")).alias("gaps"),
        F.lit(None).cast("double").alias("empty"),
    )


def test_quantiles_are_exact(skewed):
    got = {(r["column_name"], r["share"]): r["value"]
           for r in profile.quantiles(skewed, ["hot", "wide", "gaps", "empty"]).collect()}
    pdf = skewed.toPandas()
    for c in ("hot", "wide", "gaps"):
        for share in (0.25, 0.5, 0.75):
            assert got[c, share] == pytest.approx(np.quantile(pdf[c].dropna(), share), rel=1e-12), (c, share)
    assert got["empty", 0.5] is None


def test_quantiles_of_few_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "v double")
    assert [r["value"] for r in profile.quantiles(df, ["v"]).orderBy("share").collect()] == [1.5, 2.0, 6.0]
    for n in (1, 2, 4, 5, 10, 17, 64):
        some = spark.range(n).select(F.pow("id", F.lit(2)).cast("double").alias("v"))
        got = [r["value"] for r in profile.quantiles(some, ["v"]).orderBy("share").collect()]
        assert got == list(np.quantile([float(i * i) for i in range(n)], [0.25, 0.5, 0.75])), n


@pytest.mark.parametrize("bins, few", [(4, 1), (16, 10), (2048, 4096)])
def test_quantiles_by_any_number_of_rounds(spark, monkeypatch, bins, few):
    """Negative, tiny, huge and infinite values, both zeros, one hot value: brackets narrow until they are exact."""
    monkeypatch.setattr(profile, "BINS", bins)
    monkeypatch.setattr(profile, "FEW", few)
    rng = np.random.default_rng(7)
    wide = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, np.inf, -np.inf]])
    hot = np.where(rng.random(307) < 0.6, 42.0, rng.integers(-5, 5, 307))
    df = spark.createDataFrame([(float(a), float(b), None if i % 3 else 7.0) for i, (a, b) in enumerate(zip(wide, hot))], "wide double, hot double, one double")
    got = {(r["column_name"], r["share"]): r["value"] for r in profile.quantiles(df, ["wide", "hot", "one"], (0.0, 0.25, 0.5, 1.0)).collect()}
    for share in (0.0, 0.25, 0.5, 1.0):
        place = share * 306
        low, high = (np.sort(wide)[int(f(place))] for f in (np.floor, np.ceil))
        assert got["wide", share] == (low if low == high else pytest.approx(low + (high - low) * (place % 1), rel=1e-12))
        assert got["hot", share] == np.quantile(hot, share) and got["one", share] == 7.0


def test_the_bins_of_a_bracket_cover_it(monkeypatch):
    monkeypatch.setattr(profile, "BINS", 8)
    for low, high in ((-1.0, 1.0), (0.0, 5e-324), (-1e308, 1e308), (1.0, 1.0000000000000002)):
        steps = profile._steps(low, high)
        values = np.array([low, high, (low + high) / 2])
        bins = np.searchsorted(steps, profile._order(values), side="right") - 1
        assert bins.min() >= 0 and bins.max() < 8 and (np.diff(steps) >= 0).all()


def test_histogram_of_one_value_and_closed_last_bin(spark):
    rows = [(1, 5.0)] * 3 + [(0, float(v)) for v in range(101)]
    df = spark.createDataFrame(rows, "target int, LIMIT_BAL double")
    bins = {(r["target"], r["bin"]): r["n"] for r in profile.class_histogram(df).collect()}
    assert len(bins) == 100 and sum(bins.values()) == 104
    assert bins[1, 25] == 3
    assert bins[0, 49] == 3  # 98, 99 and the maximum


def test_null_profile_lists_only_columns_with_nulls(skewed):
    rows = [tuple(r) for r in profile.null_profile(skewed).collect()]
    assert rows == [("empty", 6000, 100.0), ("gaps", 1500, 25.0)]


def test_correlation_skips_missing_columns_and_is_symmetric(spark):
    df = spark.createDataFrame([(1.0, 10, 0), (2.0, 20, 1), (3.0, None, 1)], "LIMIT_BAL double, AGE int, target int")
    cells = {(r["col_a"], r["col_b"]): r["corr"] for r in profile.correlation(df).collect()}
    assert len(cells) == 9
    assert cells["LIMIT_BAL", "AGE"] == cells["AGE", "LIMIT_BAL"] == 1.0


def test_schema_listing(spark):
    df = spark.createDataFrame([(1, "a")], "a int, b string")
    assert [tuple(r) for r in profile.schema_listing(df).collect()] == [(0, "a", "int"), (1, "b", "string")]
