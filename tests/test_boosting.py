"""The boosted trees against a plain learner, and what is built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.builders import applicant, table

from creditloom import fixed as X
from creditloom.operators import boosting, metrics, model, tree_explain, tuning
from creditloom.operators.boosting import Params
from creditloom.operators.features import add_features
from creditloom.plans import training

NAMES = ["a", "b", "c"]


def shrunk(g, l1):
    return np.sign(g) * max(abs(g) - l1, 0.0)


def plain_learner(rows, y, weight, params, edges, chosen_columns, chosen_rows):
    """Margins after all trees: recursive, one node at a time, all thresholds tried."""
    margin = np.zeros(len(rows))

    def leaf(g, h):
        return -params.rate * shrunk(g, params.l1) / (h + params.l2)

    for tree in range(params.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = (np.rint(v * 2**24) / 2**24 for v in (weight * (p - y), weight * p * (1 - p)))
        learnt = chosen_rows(tree)
        value = np.zeros(len(rows))

        def grow(here, depth):
            mine = here & learnt
            G, H = g[mine].sum(), h[mine].sum()
            best = (1e-9, None)
            if depth < params.depth:
                for f in chosen_columns(tree):
                    for edge in edges[f]:
                        left = mine & (rows[:, f] <= edge)
                        gl, hl = g[left].sum(), h[left].sum()
                        gr, hr = G - gl, H - hl
                        if min(hl, hr) < params.child_weight or min(hl, hr) <= 0:
                            continue
                        worth = [shrunk(x, params.l1) ** 2 / (z + params.l2) for x, z in ((gl, hl), (gr, hr), (G, H))]
                        gain = 0.5 * (worth[0] + worth[1] - worth[2]) - params.gamma
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, edge))
            if best[1] is None:
                value[here] = leaf(G, H)
                return
            f, edge = best[1]
            grow(here & (rows[:, f] <= edge), depth + 1)
            grow(here & (rows[:, f] > edge), depth + 1)

        grow(np.ones(len(rows), bool), 0)
        margin += value
    return margin


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    rows = np.column_stack([rng.integers(0, 12, 400), rng.integers(0, 7, 400), np.round(rng.normal(size=400), 1)]).astype(float)
    y = (rows[:, 0] + 2 * rows[:, 1] + 4 * rows[:, 2] + rng.normal(size=400) * 3 > 12).astype(float)
    return rows, y, np.where(y == 1, 1.7, 1.0)


def frame(spark, data, parts=3):
    rows, y, w = data
    values = [(i, *map(float, r), int(t), float(v), i % 4) for i, (r, t, v) in enumerate(zip(rows, y, w))]
    return spark.createDataFrame(values, "id long, a double, b double, c double, y int, w double, fold int").repartition(parts)


ARGS = dict(names=NAMES, label="y", weight="w", key="id")
VARIANTS = [
    Params(trees=10, depth=2), Params(trees=2, depth=4, rate=0.1, l1=2.0, l2=0.1, gamma=0.5, child_weight=3.0),
    Params(trees=4, depth=2, columns=0.6, seed=5), Params(trees=4, depth=3, subsample=0.7, seed=9), Params(trees=1, depth=1, child_weight=1000.0),
]


@pytest.mark.parametrize("params", VARIANTS)
def test_equals_a_plain_learner(spark, data, params):
    rows, y, w = data
    df = frame(spark, data)
    edges = boosting.bin_edges(df, NAMES)
    got = boosting.train(df, params, **ARGS)

    def columns(tree):
        rng = np.random.default_rng([params.seed, tree])
        return np.sort(rng.choice(3, max(1, round(params.columns * 3)), replace=False))

    hashes = np.array([r["h"] for r in df.orderBy("id").select(F.xxhash64("id").alias("h")).collect()])

    def learnt(tree):
        return boosting._draw(hashes, params.seed, tree) < params.subsample if params.subsample < 1 else np.ones(len(y), bool)

    assert got.margin(rows) == pytest.approx(plain_learner(rows, y, w, params, edges, columns, learnt), abs=1e-9)


def test_bins_hold_all_values_of_a_small_column(spark, data):
    edges = boosting.bin_edges(frame(spark, data), NAMES)
    assert edges[0].tolist() == list(range(11)) and edges[1].tolist() == list(range(6))
    assert len(boosting.bin_edges(spark.range(10_000).select(F.col("id").alias("a")), ["a"])[0]) == boosting.BINS - 1


def test_a_model_does_not_depend_on_how_rows_are_dealt_out(spark, data):
    params = Params(trees=3, depth=3, subsample=0.8, columns=0.7)
    models = [boosting.train(frame(spark, data, parts), params, **ARGS) for parts in (1, 7)]
    for one, other in zip(models[0].trees, models[1].trees, strict=True):
        for name in ("left", "right", "feature", "threshold", "value", "cover"):
            assert np.array_equal(getattr(one, name), getattr(other, name))


def test_folds_side_by_side_equal_folds_alone(spark, data):
    df, params = frame(spark, data), [Params(trees=2, depth=2), Params(trees=3, depth=2, l1=1.0)]
    edges = boosting.bin_edges(df, NAMES)
    together = boosting.train_together(df, [(p, f) for p in params for f in range(4)], fold="fold", edges=edges, **ARGS)
    for at in (1, 6):
        got = together[at]
        alone = boosting.train_together(df.filter(F.col("fold") != at % 4), [(params[at // 4], None)], edges=edges, **ARGS)[0]
        assert got.margin(data[0]) == pytest.approx(alone.margin(data[0]), abs=1e-12)


def test_rows_with_gaps_are_refused_in_training_and_not_scored(spark, data):
    df = frame(spark, data)
    with pytest.raises(Exception, match="without one of its features"):
        boosting.train(df.withColumn("a", F.when(F.col("id") > 3, F.col("a"))), Params(trees=1), **ARGS)
    fitted = boosting.train(df, Params(trees=2), **ARGS)
    odd = spark.createDataFrame([(1.0, 2.0, 3.0), (None, 2.0, 3.0), (1.0, float("nan"), 3.0), (1.0, 2.0, 3.0)], "a double, b double, c double")
    got = [r["p"] for r in odd.select(boosting.probability(boosting.feature_array(NAMES), fitted).alias("p")).collect()]
    assert got[0] == got[3] and got[1] is None and got[2] is None
    assert boosting.train(df.limit(0), Params(trees=2), **ARGS).margin(data[0]).tolist() == [0.0] * 400


# --- On applicants -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def people(spark):
    rows = [applicant(i, int(i % 3 == 0 or i % 7 == 1), LIMIT_BAL=float(1000 + 37 * i), AGE=20 + i % 50, PAY_0=i % 9 - 2,
                      PAY_2=i % 5 - 2, BILL_AMT1=float(i * 3 % 101), PAY_AMT1=float(i % 13)) for i in range(300)]
    return add_features(table(spark, *rows)).cache()


def test_random_points_lie_in_all_nine_ranges():
    ranges = dict(trees=X.SEARCH_TREES, depth=X.SEARCH_DEPTH, rate=X.SEARCH_RATE, subsample=X.SEARCH_SUBSAMPLE, columns=X.SEARCH_COLUMN_SAMPLE,
                  child_weight=X.SEARCH_MIN_CHILD, gamma=X.SEARCH_MIN_GAIN, l1=X.SEARCH_L1, l2=X.SEARCH_L2)
    points = tuning.random_params()
    assert len(points) == X.TRIALS and points == tuning.random_params()
    for name, (low, high) in ranges.items():
        values = [getattr(p, name) for p in points]
        assert low <= min(values) < low + (high - low) / 4 and high - (high - low) / 4 < max(values) <= high


def test_search_ranks_trials_by_mean_auc(spark, people):
    weighted = model.with_class_weight(people)
    found = tuning.search(weighted, n=3, k=2, trees=(2, 4), depth=(2, 3))
    report = {r["trial"]: r for r in found.report().collect()}
    assert sorted(report) == [0, 1, 2] and all(len(r["params"]) == 9 for r in report.values())
    best = max(report.values(), key=lambda r: (r["mean_auc"], -r["trial"]))
    assert found.trials[best["trial"]] == found.best
    # The same fold, trained and scored on its own.
    folded = model.stratified_folds(weighted, k=2)
    alone = boosting.train_together(folded, [(found.trials[1], 0)], weight=model.WEIGHT, fold="fold", edges=boosting.bin_edges(folded))[0]
    scored = folded.filter("fold = 0").withColumn("p", boosting.probability(boosting.feature_array(), alone))
    want = metrics.roc_auc(scored, "p").first()["roc_auc"]
    assert found.aucs.filter("trial = 1 AND fold = 0").first()["roc_auc"] == want


def test_out_of_fold_scores_every_row_by_a_model_that_has_not_seen_it(spark, people):
    rows = tuning.out_of_fold(model.with_class_weight(people), Params(trees=2, depth=2), k=3)
    assert rows.count() == rows.select(X.KEY).distinct().count() == 300
    folded = model.stratified_folds(model.with_class_weight(people), k=3)
    fitted = boosting.train_together(folded, [(Params(trees=2, depth=2), 1)], weight=model.WEIGHT, fold="fold")[0]
    want = folded.filter("fold = 1").select(X.KEY, boosting.probability(boosting.feature_array(), fitted).alias("p"))
    assert rows.filter("fold = 1").select(X.KEY, "risk_probability").exceptAll(want).count() == 0


def test_bundle_keeps_the_model_when_the_threshold_changes(spark, people, tmp_path):
    fitted, path = boosting.train(people, Params(trees=3, depth=3)), str(tmp_path / "bundle")
    tuning.save_bundle(spark, fitted, 0.5, path)
    first = tuning.load_bundle(spark, path)
    model.set_threshold(spark, 0.6, path)
    second = tuning.load_bundle(spark, path)
    assert (first.threshold, first.version, second.threshold, second.version) == (0.5, 0, 0.6, 1)
    scores = [tuning.score(people, b).orderBy(X.KEY).collect() for b in (tuning.Bundle(fitted, 0.5), first, second)]
    assert scores[0] == scores[1]
    for a, b in zip(scores[1], scores[2]):
        assert a["risk_probability"] == b["risk_probability"]
        assert b["risk_decision"] == (X.REJECT if b["risk_probability"] >= 0.6 else X.APPROVE)


def test_contributions_add_up_and_gaps_stay_open(spark, people):
    bundle = tuning.Bundle(boosting.train(people, Params(trees=5, depth=4)), 0.5)
    odd = people.withColumn("LIMIT_BAL", F.when(F.col(X.KEY) != 7, F.col("LIMIT_BAL")))
    for r in tuning.contributions(tuning.score(odd, bundle), bundle).collect():
        if r[X.KEY] == 7:
            assert r["risk_probability"] is None and r["risk_decision"] is None and r["contributions"] is None
        else:
            total = r["base_value"] + sum(c["impact"] for c in r["contributions"])
            assert 1 / (1 + np.exp(-total)) == pytest.approx(r["risk_probability"], abs=1e-4)


def test_training_job(spark, people, tmp_path):
    trained = training.training_job(people, str(tmp_path / "m"), trials=2, k=2, trees=(2, 3), depth=(2, 3))
    assert trained.out_of_fold.count() == 240 and trained.held_out.count() == 60 and trained.search.count() == 2
    assert trained.bundle.threshold == metrics.best_threshold(trained.out_of_fold).first()["threshold"]
    told = spark.read.json(str(tmp_path / "m/metrics")).first()
    assert told["roc_auc"] == metrics.roc_auc(trained.held_out).first()["roc_auc"]
    given = training.training_job(people, str(tmp_path / "g"), Params(trees=2, depth=2))
    assert given.search is None and given.params == Params(trees=2, depth=2)


def test_explain_job(spark, people):
    bundle = tuning.Bundle(boosting.train(people, Params(trees=3, depth=3)), 0.5)
    told = training.explain_job(people.filter(F.col(X.KEY) < 50), bundle)
    assert told["points"].count() == 50 * len(X.FEATURE_COLUMNS)
    importance = told["importance"].collect()
    assert [r["rank"] for r in importance] == list(range(1, 11))
    rows = told["extremes"].collect()
    scores = {r[X.KEY]: r["risk_probability"] for r in tuning.score(people.filter(F.col(X.KEY) < 50), bundle).collect()}
    riskiest = {r[X.KEY] for r in rows if r["kind"] == "riskiest"}
    assert riskiest == {min(k for k, v in scores.items() if v == max(scores.values()))} and len(rows) == 2 * X.TOP_REPORT
    assert told["base"].first()["base_value"] == pytest.approx(tree_explain.base_value(list(bundle.model.trees)), abs=1e-6)


def test_rows_reach_the_leaf_their_tests_lead_to():
    """Against one row at a time; trees of uneven depth, a single leaf, missing values, no rows."""
    from creditloom.operators.boosting import _routed
    from creditloom.operators.tree_explain import Tree

    rng = np.random.default_rng(4)
    left, right, feature = np.array([1, 3, -1, -1, 5, -1, -1]), np.array([2, 4, -1, -1, 6, -1, -1]), np.array([0, 2, -1, -1, 1, -1, -1])
    deep = Tree(left, right, feature, np.array([3.0, 1.0, 0, 0, 2.0, 0, 0]), np.zeros(7), np.ones(7))
    leaf = Tree(np.array([-1]), np.array([-1]), np.array([-1]), np.zeros(1), np.zeros(1), np.ones(1))
    matrix = rng.integers(0, 6, (200, 3)).astype(float)
    matrix[::9, 1] = np.nan

    def slow(tree, row):
        at = 0
        while tree.left[at] >= 0:
            at = tree.left[at] if row[tree.feature[at]] <= tree.threshold[at] else tree.right[at]
        return at

    for tree in (deep, leaf):
        for rows in (matrix, matrix[:0], np.asfortranarray(matrix), np.nan_to_num(matrix).astype(np.uint8)):
            assert _routed(tree, rows).tolist() == [slow(tree, row) for row in rows]
