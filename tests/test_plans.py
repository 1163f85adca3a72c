"""What the physical plans must and must not contain."""

import re
from pathlib import Path

import pytest

from checks.queries import QUERIES

LIBRARY = Path(__file__).resolve().parents[1] / "creditloom"

LIGHT = [
    "b8_rate_by_sex", "b11_correlation", "d10_feature_table", "e1_stratified_split", "e3_stratified_folds",
    "f5_best_threshold", "f7_metrics", "f9_roc_auc", "g4_top_factors", "g5_global_importance", "g6_category_impact",
    "h3_section_windows", "h8_requested_regulation", "h12_applicant_question", "h16_citation_check",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LIGHT)
def test_no_nested_loops_and_no_python(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_scans_read_only_what_is_needed(spark, small):
    text = plan(QUERIES["c2_marriage_recode"](spark, small))
    assert "l_quantity" not in text and "l_extendedprice" not in text
    assert "WindowGroupLimit" in text  # the latest seven are cut before the shuffle


def test_row_wise_features_do_not_shuffle(spark, small):
    from creditloom.operators.features import add_features
    from creditloom import schemas as S

    df = add_features(spark.read.schema(S.APPLICANT).parquet(f"{small}/customer.parquet"))
    assert "Exchange" not in plan(df)


def test_chunking_does_not_shuffle(spark, small):
    assert "Exchange" not in plan(QUERIES["h4_chunk_labels"](spark, small))


def test_library_never_collects_data():
    text = "\n".join(p.read_text() for p in LIBRARY.rglob("*.py"))
    for word in (r"\.collect\(", r"toPandas\(", r"localCheckpoint", r"crossJoin\(", r"\.rdd\b", r"coalesce\(1\)\.write\.csv"):
        assert not re.search(word, text), word


@pytest.mark.parametrize("name", ["h7_nearest_vectors", "h10_hybrid_route", "h15_title_match", "j1_portfolio_underwriting", "b12_dataset_summary"])
def test_final_plans_have_no_nested_loops(spark, small, name):
    """As they ran, after adaptive changes."""
    df = QUERIES[name](spark, small)
    assert df.count() > 0
    df.write.format("noop").mode("overwrite").save()
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_the_feature_job_scans_its_input_once(spark, small, tmp_path, monkeypatch):
    from creditloom.operators import split
    from creditloom.plans import billing, jobs

    seen, real = [], split.stratified_split
    monkeypatch.setattr(jobs.split, "stratified_split", lambda df: seen.append(plan(df)) or real(df))
    people = billing.applicants(spark, small)
    assert "lineitem" in plan(people)
    told = jobs.feature_job(people, str(tmp_path / "f"))
    assert len(seen) == 1 and "lineitem" not in seen[0]
    assert told == {"rows": spark.read.parquet(str(tmp_path / "f")).count(), "columns": 31}


def test_the_split_reads_full_rows_once(spark, small):
    from creditloom.operators import split
    from creditloom.plans import billing

    text = plan(split.stratified_split(billing.applicants(spark, small)))
    assert text.count("lineitem.parquet") <= 1
