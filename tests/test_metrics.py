import random

import pytest

from creditloom import fixed as X
from creditloom.functions import running
from creditloom.operators import metrics
from creditloom.operators.score import decision
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(3)
    # A third of the rows shares one score.
    return [(0.35 if rng.random() < 0.33 else round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(700)]


@pytest.fixture(scope="module")
def scores(spark, pairs):
    return spark.createDataFrame(pairs, "risk_probability double, target int").cache()


def f1(pairs, t):
    tp = sum(1 for s, y in pairs if s >= t and y)
    fp = sum(1 for s, y in pairs if s >= t and not y)
    fn = sum(1 for s, y in pairs if s < t and y)
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


def test_sweep_counts_every_row_once(scores, pairs):
    rows = metrics.threshold_sweep(scores, metrics.sweep_thresholds()).orderBy("threshold").collect()
    assert len(rows) == 61
    for r in rows:
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == len(pairs)
        assert r["tp"] == sum(1 for s, y in pairs if s >= r["threshold"] and y)
        assert r["f1_score"] == pytest.approx(f1(pairs, r["threshold"]), abs=1e-6)
    recalls = [r["recall"] for r in rows]
    assert recalls == sorted(recalls, reverse=True)


def test_best_threshold_is_the_lowest_of_the_best(scores, pairs):
    best = metrics.best_threshold(scores).first()
    wanted = max(metrics.sweep_thresholds(), key=lambda t: (f1(pairs, t), -t))
    assert best["threshold"] == wanted


def test_equal_f1_takes_the_lowest_threshold(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 0)], "risk_probability double, target int")
    assert metrics.best_threshold(df).first()["threshold"] == 0.2


def test_no_positive_falls_back(spark):
    df = spark.createDataFrame([(0.9, 0), (0.1, 0)], "risk_probability double, target int")
    assert tuple(metrics.best_threshold(df).first()) == (0.5, 0.0)


def test_auc_counts_ties_half(scores, pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert metrics.roc_auc(scores).first()["roc_auc"] == pytest.approx(wins / len(pos) / len(neg), abs=1e-6)


def test_auc_of_one_class_is_undefined(spark):
    df = spark.createDataFrame([(0.9, 0), (0.1, 0)], "risk_probability double, target int")
    assert metrics.roc_auc(df).first()["roc_auc"] is None
    row = metrics.classification_metrics(df).first()
    assert row["accuracy"] == 0.5 and row["precision"] == 0.0 and row["naive_baseline"] == 1.0


def test_metrics_agree_with_their_parts(scores):
    row = metrics.classification_metrics(scores, 0.5).first()
    sweep = metrics.threshold_sweep(scores, [0.5]).first()
    assert all(row[c] == sweep[c] for c in ("accuracy", "precision", "recall", "f1_score"))
    assert row["roc_auc"] == metrics.roc_auc(scores).first()["roc_auc"]
    assert row["naive_baseline"] == metrics.naive_baseline(scores).first()["naive_baseline"]


def test_confusion_has_four_cells_that_sum_up(spark, scores, pairs):
    assert sum(r["n"] for r in metrics.confusion_matrix(scores).collect()) == len(pairs)
    df = spark.createDataFrame([(0.9, 1)], "risk_probability double, target int")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 1}


def test_current_threshold_is_marked(scores):
    marked = [r["threshold"] for r in metrics.threshold_table(scores).collect() if r["is_current"]]
    assert marked == [0.55]


def test_probability_at_the_threshold_is_rejected(spark):
    df = spark.createDataFrame([(0.55,), (0.549999,)], "p double")
    got = [r["d"] for r in df.select(decision(F.col("p"), 0.55).alias("d")).collect()]
    assert got == [X.REJECT, X.APPROVE]


@pytest.mark.parametrize("rows", [[(0.9, 1), (None, 1)], [(float("nan"), 0), (0.1, 1)], [(0.5, None), (0.2, 0)]])
def test_rows_without_score_or_label_are_refused(spark, rows):
    df = spark.createDataFrame(rows, "risk_probability double, target int")
    for report in (metrics.threshold_table, metrics.confusion_matrix, metrics.roc_auc):
        with pytest.raises(Exception, match="without a score"):
            report(df).collect()


def plain_auc(rows):
    pairs = [(p > n) + (p == n) / 2 for p, is_pos in rows if is_pos for n, other in rows if not other]
    return round(sum(pairs) / len(pairs), 6) if pairs else None


def test_auc_of_any_scores_and_groups(spark):
    """Scores outside 0..1, huge and negative ones, ties; per group as alone."""
    rng = random.Random(4)
    rows = [(g, rng.choice([-1e12, -3.5, 0.0, 0.1, 0.7, 2.0, 1e9, rng.random() * 100]), int(rng.random() < 0.4)) for g in "abb" * 60]
    rows += [("c", 0.5, 1)]  # one class only
    df = spark.createDataFrame(rows, "g string, margin double, y int")
    got = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(df, "margin", "y", by=["g"]).collect()}
    assert got == {g: plain_auc([(s, y) for h, s, y in rows if h == g]) for g in "abc"}
    assert metrics.roc_auc(df, "margin", "y").first()["roc_auc"] == plain_auc([(s, y) for _, s, y in rows])


def test_running_numbers_and_sums(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(50), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b long, v long").repartition(7)
    in_order = sorted(rows)
    got = {(r["a"], r["b"]): (r["at"], r["below"]) for r in running.sum_below(running.numbered(df, ["a", "b"], "at"), ["a", "b"], "v", "below").collect()}
    assert got == {row[:2]: (at, sum(v for *_, v in in_order[:at])) for at, row in enumerate(in_order)}
    assert running.numbered(df.limit(0), ["a"], "at").count() == 0 and running.sum_below(df.limit(0), ["a"], "v", "s").count() == 0
