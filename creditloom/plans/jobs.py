"""Whole jobs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import fixed as X
from .. import schemas as S
from ..operators import clean, explain, features, profile, retrieve, split, tuning
from ..operators.corpus import chunk
from ..operators.nearest import Index
from ..operators.report import memo_facts, report
from ..operators.score import DELAY_SCORECARD, Scorecard, score
from ..operators.tuning import Bundle
from ..operators.vectors import with_counts
from ..session import materialize, scratch_path, tidy

CAPPED_SPREAD = 4096


# --- Features -------------------------------------------------------------------

def feature_table(applicants: DataFrame, empty_limit: float | None = None) -> DataFrame:
    """Clean, engineer and select; nulls mark a limit of 0, as training data wants it."""
    return features.final_columns(features.add_features(clean.recode(applicants), empty_limit))


def feature_job(applicants: DataFrame, path: str, mode: str = "errorifexists") -> dict[str, int]:
    """Feature table with its train and test part in separate folders; tells its rows and columns.

    The features are worked out and written once, and counted by that same job;
    the split reads them back.
    """
    counted = Observation("features")
    features_once = feature_table(applicants).observe(counted, F.count(F.lit(1)).alias("rows"))
    table = materialize(features_once, "features")
    split.stratified_split(table).write.mode(mode).partitionBy("split").parquet(path)
    return {**counted.get, "columns": len(table.columns)}


# --- Corpus ----------------------------------------------------------------------

def chunk_store(documents: DataFrame) -> DataFrame:
    """Chunks with their word counts. Texts are dealt out first: cutting and counting them is the work, and a file
    of one row group would be one task."""
    dealt = documents.select("doc_id", "text").repartition("doc_id", F.xxhash64("text"))
    return with_counts(chunk(dealt))


def corpus_job(documents: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Build the chunk store; an existing one is kept unless overwritten."""
    chunk_store(documents).write.mode("overwrite" if overwrite else "ignore").parquet(path)
    return read_store(documents.sparkSession, path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.STORE).parquet(path)


# --- Profile ---------------------------------------------------------------------

def profile_job(applicants: DataFrame) -> dict[str, DataFrame]:
    """All reports on one table. Cache or write the table first: each report scans it."""
    return {
        "shape": profile.shape(applicants),
        "preview": profile.preview(applicants),
        "schema": profile.schema_listing(applicants),
        "classes": profile.class_distribution(applicants),
        "nulls": profile.null_profile(applicants),
        "describe": profile.describe(applicants, ["LIMIT_BAL", "AGE"]),
        "limit_histogram": profile.class_histogram(applicants),
        "rate_by_sex": profile.default_rate(applicants, "SEX"),
        "rate_by_education": profile.default_rate(applicants, "EDUCATION").orderBy(F.desc("default_rate_pct"), "EDUCATION"),
        "rate_by_status": profile.default_rate(applicants, "PAY_0").orderBy("PAY_0"),
        "correlation": profile.correlation(applicants),
    }


def profile_summary(reports: Mapping[str, DataFrame]) -> DataFrame:
    """The reports with a number per group, as (report, item, value) rows."""

    def rows(name: str, item: Column, value: str) -> DataFrame:
        return reports[name].select(
            F.lit(name).alias("report"), item.alias("item"), F.col(value).cast("double").alias("value"))

    parts = [
        rows("shape", F.lit("rows"), "n_rows"),
        rows("classes", F.col(X.TARGET).cast("string"), "pct"),
        rows("nulls", F.col("column_name"), "null_pct"),
        rows("describe", F.col("column_name"), "mean"),
        rows("limit_histogram", F.concat_ws("/", X.TARGET, "bin"), "n"),
        rows("rate_by_sex", F.col("SEX").cast("string"), "default_rate_pct"),
        rows("rate_by_education", F.col("EDUCATION").cast("string"), "default_rate_pct"),
        rows("rate_by_status", F.col("PAY_0").cast("string"), "default_rate_pct"),
        rows("correlation", F.concat_ws("/", "col_a", "col_b"), "corr"),
    ]
    summary = parts[0]
    for part in parts[1:]:
        summary = summary.unionByName(part)
    return summary


# --- Underwriting --------------------------------------------------------------------

def assess(
    applicants: DataFrame, card: Scorecard | Bundle = DELAY_SCORECARD, means: Mapping[str, float] | None = None,
    given: Column | None = None,
) -> DataFrame:
    """Validate and flag the raw values, recode, engineer, score, attribute, ask. No join, no shuffle
    apart from the one-row means of a card, and none at all when those are given.

    A bundle scores and attributes by its trees, which travel with the tasks; an
    applicant without one of the features gets neither score nor decision from it.
    """
    featured = features.add_features(clean.recode(clean.validate(applicants)))
    if isinstance(card, Bundle):
        explained = tuning.contributions(tuning.score(featured, card), card)
    else:
        explained = explain.linear_contributions(score(featured, card), card, means)
    return explained.withColumns({
        "top_risk_factors": explain.top_factors(F.col("contributions")),
        "compliance_question": retrieve.applicant_question(given),
    })


def answer_questions(
    questions: DataFrame, store: DataFrame, k: int = X.TOP_K, parts: DataFrame | None = None, index: Index | None = None,
) -> DataFrame:
    """(question_id, answer, sources): overview first, then exact, then nearest."""
    overview = retrieve.answer_overviews(questions, store)
    specific = questions.filter(~retrieve.is_overview(F.col("question")))
    found = retrieve.answers(retrieve.hybrid(specific, store, k, parts, index)).withColumnRenamed("context", "answer")
    return overview.unionByName(found)


def question_job(questions: DataFrame, store: DataFrame, k: int = X.TOP_K, index: Index | None = None) -> DataFrame:
    """(question_id, context, sources): the title match, where there is one, in front of the nearest chunks."""
    near = retrieve.attach_chunks(retrieve.nearest_chunks(questions, store if index is None else index, k), store)
    return retrieve.answers(retrieve.with_title_match(near, questions, store))


def attach_answers(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers beside the applicants, and what else `answers` has, as columns of the same names.

    The two cap questions are shared by a large part of any portfolio. They are
    two rows, so they are broadcast; the applicants asking them are spread over
    all partitions of the second join, where they match nothing.
    """
    capped = F.col("compliance_question").isin(X.QUESTION_AGGREGATE, X.QUESTION_CLEAN)
    is_cap = F.col("question_id").isin(X.QUESTION_AGGREGATE, X.QUESTION_CLEAN)
    told = [name for name in answers.columns if name != "question_id"]
    cap = answers.filter(is_cap).select(F.col("question_id").alias("_cap"), *[F.col(name).alias(f"_cap_{name}") for name in told])
    other = answers.filter(~is_cap).select(F.col("question_id").alias("_key"), *[F.col(name).alias(f"_{name}") for name in told])
    spread = F.concat(F.lit("#"), F.pmod(F.xxhash64(X.KEY), F.lit(CAPPED_SPREAD)).cast("string"))
    keyed = asked.withColumn("_key", F.when(capped, spread).otherwise(F.col("compliance_question")))
    joined = keyed.join(F.broadcast(cap), F.col("compliance_question") == F.col("_cap"), "left").join(other, "_key", "left")
    return joined.withColumns({
        "compliance_answer": F.coalesce("_cap_answer", "_answer"),
        "compliance_sources": F.coalesce("_cap_sources", "_sources", F.array().cast("array<string>")),
        **{name: F.coalesce(f"_cap_{name}", f"_{name}") for name in told if name not in ("answer", "sources")},
    }).drop("_key", "_cap", *[f"{side}_{name}" for side in ("_cap", "") for name in told])


def underwrite(
    applicants: DataFrame, store: DataFrame, card: Scorecard | Bundle = DELAY_SCORECARD, k: int = X.TOP_K,
    means: Mapping[str, float] | None = None, given: Column | None = None, parts: DataFrame | None = None,
    index: Index | None = None,
) -> DataFrame:
    """A decision, its reasons, the regulation it rests on and the report, for every applicant.

    Equal questions are answered once. `parts` and `index` are the regulation
    table and the index of the store, for callers that come back with more
    applicants.
    """
    asked = assess(applicants, card, means, given)
    text = F.col("compliance_question")
    questions = asked.select(text.alias("question_id"), text.alias("question")).distinct()
    written = materialize(questions, "questions")
    tidy(applicants.sparkSession)
    found = answer_questions(written, store, k, parts, index)
    # An answer and its sources are nearly all of a report: what they cite is looked for once per question.
    text = F.concat_ws("\n", "answer", F.array_join("sources", ", "))
    answers = materialize(found.withColumn("_uncovered", retrieve.unsupported_citations(text, F.col("sources"))), "answers")
    tidy(applicants.sparkSession)
    answered = attach_answers(asked, answers)
    parts = [F.col(c) for c in ("risk_decision", "risk_probability", "top_risk_factors", "compliance_answer")]
    return answered.withColumns({
        "final_report": report(F.col("data_warnings"), *parts, F.col("compliance_sources")),
        "memo_facts": memo_facts(*parts),
        "unsupported": _unsupported(),
    }).drop("_uncovered")


def _unsupported() -> Column:
    """Regulations the report cites that are not among its sources: in what is the applicant's own, then in the answer. No
    citation reaches from one part of the report into the next, as the report's own words stand between them."""
    own = F.concat_ws("\n", "data_warnings", "risk_decision", F.transform("top_risk_factors", lambda f: f["feature"]))
    none = F.array().cast("array<string>")
    return F.array_union(retrieve.unsupported_citations(own, F.col("compliance_sources")), F.coalesce("_uncovered", none))


def portfolio_means(applicants: DataFrame, card: Scorecard = DELAY_SCORECARD) -> dict[str, float]:
    """The four or so feature means a linear attribution is measured against; one row."""
    row = explain.feature_means(features.add_features(clean.recode(applicants)), list(card.weights)).first()
    return row.asDict()


def decision_log(underwritten: DataFrame, decided_at: Column, entry_id: Column) -> DataFrame:
    """Rows for the append-only decision log, nested parts as real types."""
    return underwritten.select(
        entry_id.alias("id"), decided_at.alias("decided_at"), X.KEY,
        F.struct(*X.FEATURE_COLUMNS).alias("applicant_data"),
        "risk_probability", "risk_decision", "top_risk_factors",
        "compliance_question", "compliance_answer", "compliance_sources",
    )


def scratch_store(documents: DataFrame) -> DataFrame:
    """A chunk store for one run, below the shared folder."""
    return corpus_job(documents, scratch_path(documents.sparkSession, "store"))


def scratch_chunks(documents: DataFrame) -> DataFrame:
    """Chunks without counts, for exact lookups only."""
    return materialize(chunk(documents), "chunks")
