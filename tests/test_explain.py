from itertools import permutations

import numpy as np
import pytest
from tests.builders import applicant, table
from pyspark.sql import functions as F

from creditloom import fixed as X
from creditloom import schemas as S
from creditloom.operators import explain, model, tree_explain
from creditloom.operators.features import add_features
from creditloom.operators.score import DELAY_SCORECARD, score


@pytest.fixture(scope="module")
def people(spark):
    rows = [applicant(i, int(i % 3 == 0 or i % 7 == 1), LIMIT_BAL=float(1000 + 37 * i), AGE=20 + i % 50, PAY_0=i % 9 - 2,
                      PAY_2=i % 5 - 2, BILL_AMT1=float(i * 3 % 101), PAY_AMT1=float(i % 13)) for i in range(300)]
    return add_features(table(spark, *rows)).cache()


@pytest.fixture(scope="module")
def fitted(people):
    return model.train(people, maxIter=4, maxDepth=3)


def test_tree_contributions_add_up_to_the_log_odds(people, fitted):
    rows = tree_explain.tree_contributions(model.predict(fitted, people), tree_explain.model_trees(fitted), 12).collect()
    raw = {r[X.KEY]: r["rawPrediction"][1] for r in fitted.transform(people).collect()}
    for r in rows:
        total = r["base_value"] + sum(c["impact"] for c in r["contributions"])
        assert total == pytest.approx(2 * raw[r[X.KEY]], abs=1e-6)
        assert 1 / (1 + np.exp(-total)) == pytest.approx(r["risk_probability"], abs=1e-5)
    assert [c["feature"] for c in rows[0]["contributions"]] == X.FEATURE_COLUMNS


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_a_leaf_has_shapley_values(m):
    """Against the mean over all orders in which its features join."""
    shares = np.random.default_rng(m).uniform(0, 1, m)
    shares[0] = 0.0  # a branch without training weight
    holds = np.array([[(mask >> j) & 1 for j in range(m)] for mask in range(2**m)], dtype=float)
    got = tree_explain._shapley(holds, shares)
    for mask in range(2**m):
        def worth(joined):
            return np.prod([holds[mask][j] if j in joined else shares[j] for j in range(m)])

        for i in range(m):
            gains = [worth({*order[:order.index(i)], i}) - worth(set(order[:order.index(i)])) for order in permutations(range(m))]
            assert got[mask, i] == pytest.approx(np.mean(gains), abs=1e-12)


def test_deep_trees_are_explained(people):
    deep = model.train(people, maxIter=2, maxDepth=10)
    rows = tree_explain.tree_contributions(model.predict(deep, people), tree_explain.model_trees(deep), 12).collect()
    raw = {r[X.KEY]: r["rawPrediction"][1] for r in deep.transform(people).collect()}
    for r in rows:
        assert r["base_value"] + sum(c["impact"] for c in r["contributions"]) == pytest.approx(2 * raw[r[X.KEY]], abs=1e-6)


def test_linear_contributions_with_fixed_means(people):
    means = {c: 0.0 for c in DELAY_SCORECARD.weights}
    row = explain.linear_contributions(score(people), means=means).first()
    total = sum(c["impact"] for c in row["contributions"]) + DELAY_SCORECARD.intercept
    assert 1 / (1 + np.exp(-total)) == pytest.approx(row["risk_probability"], abs=1e-5)


def test_top_factors_keep_feature_order_on_ties(spark):
    entries = [("a", 1.0, 0.0), ("b", -2.0, 0.0), ("c", 2.0, 0.0), ("d", -1.0, 0.0)]
    df = spark.createDataFrame([(entries,)], "c array<struct<feature:string,impact:double,value:double>>")
    got = df.select(explain.top_factors(F.col("c").cast(S.FACTORS), 3).alias("t")).first()["t"]
    assert [e["feature"] for e in got] == ["b", "c", "a"]


def test_extremes_take_the_first_on_ties(spark):
    df = spark.createDataFrame([(3, 0.9), (2, 0.9), (5, 0.1), (4, 0.1)], "applicant_id long, risk_probability double")
    rows = {r["kind"]: r[X.KEY] for r in explain.extremes(df).collect()}
    assert rows == {"riskiest": 2, "safest": 4}


def test_search_keeps_one_result_per_trial(spark, people):
    best, trials = model.search(people, n=2, k=2, trees=(1, 2), depth=(2, 2))
    report = model.search_report(spark, best, trials).collect()
    assert [r["trial"] for r in report] == [0, 1] and all(0 <= r["mean_auc"] <= 1 for r in report)


def test_out_of_fold_scores_every_row_once(people):
    rows = model.out_of_fold(people, k=2, maxIter=1, maxDepth=2)
    assert rows.count() == rows.select(X.KEY).distinct().count() == people.count()


def test_bundle_keeps_the_model_when_the_threshold_changes(spark, people, fitted, tmp_path):
    path = str(tmp_path / "bundle")
    model.save_bundle(fitted, 0.5, path)
    model.set_threshold(spark, 0.55, path)
    loaded, threshold = model.load_bundle(spark, path)
    assert threshold == 0.55
    a, b = model.predict(fitted, people), model.predict(loaded, people)
    assert a.exceptAll(b.withColumn("risk_decision", F.col("risk_decision"))).filter("risk_probability < 0.5").count() == 0
