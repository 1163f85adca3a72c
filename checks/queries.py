"""One query per operator; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import fixed as X
from creditloom import schemas as S
from creditloom.operators import boosting, clean, corpus, explain, features, metrics, model, profile, retrieve, split, tuning, vectors
from creditloom.operators import score as scoring
from creditloom.operators.nearest import nearest
from creditloom.operators.report import memo_facts
from creditloom.plans import billing, jobs, training
from creditloom.session import materialize, scratch_path
from creditloom.sources import readers, writers
from creditloom.streaming import requests as stream

from . import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _on_applicants(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(billing.applicants(spark, sf_dir))


def _on_features(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(inputs.features(spark, sf_dir))


def _on_scores(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(inputs.scored(spark, sf_dir))


def _on_contributions(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    # The means are a pass of their own, so the scores are written once.
    QUERIES[name] = lambda spark, sf_dir: fn(explain.linear_contributions(
        materialize(inputs.scored(spark, sf_dir), "scored")))


# --- A: sources and sinks ---------------------------------------------------------

def _csv_round_trip(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "applicants-csv")
    writers.write_csv(billing.applicants(spark, sf_dir), path)
    return path


@query("a1_applicant_csv_scan")
def _(spark, sf_dir):
    rows = readers.read_applicants_csv(spark, _csv_round_trip(spark, sf_dir))
    return rows.withColumn("is_bad", F.col(S.CORRUPT).isNotNull()).drop(S.CORRUPT)


@query("a1_scan_report")
def _(spark, sf_dir):
    """Rows, malformed rows and columns of the scan, told by the job that writes the rows on."""
    rows, counted = readers.observed_scan(readers.read_applicants_csv(spark, _csv_round_trip(spark, sf_dir)))
    rows.write.parquet(scratch_path(spark, "scanned"))
    return spark.createDataFrame([(counted.get["rows"], counted.get["bad_rows"], len(rows.columns) - 1)], "n_rows long, n_bad long, n_columns int")


@query("a2_column_rename")
def _(spark, sf_dir):
    back = {name: code for code, name in readers.coded_names().items()}
    return readers.rename_coded(billing.applicants(spark, sf_dir).withColumnsRenamed(back))


@query("a3_attach_label")
def _(spark, sf_dir):
    people = billing.applicants(spark, sf_dir).drop(X.TARGET)
    return readers.attach_label(people, billing.outcomes(spark, sf_dir))


@query("a4_csv_sink")
def _(spark, sf_dir):
    return readers.read_table(spark, _csv_round_trip(spark, sf_dir), S.APPLICANT)


@query("a5_read_by_extension")
def _(spark, sf_dir):
    labels = readers.read_table(spark, f"{sf_dir.rstrip('/')}/labels.parquet")
    path = scratch_path(spark, "labels") + ".csv"
    writers.write_csv(labels, path)
    from_csv = readers.read_table(spark, path, labels.schema)
    return labels.withColumn("kind", F.lit("parquet")).unionByName(from_csv.withColumn("kind", F.lit("csv")))


@query("a6_front_matter_cut")
def _(spark, sf_dir):
    return inputs.corpus(spark, sf_dir).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("a6_corpus_files")
def _(spark, sf_dir):
    """The documents as one text file each, read back without their front matter."""
    folder = scratch_path(spark, "texts")
    writers.write_texts(inputs.raw_corpus(spark, sf_dir), folder)
    files = readers.read_corpus(spark, f"{folder}/*")
    return files.select(F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("a7_chunk_store")
def _(spark, sf_dir):
    path = scratch_path(spark, "chunks")
    writers.write_chunks(corpus.chunk(inputs.corpus(spark, sf_dir)), path)
    return readers.read_chunks(spark, path).select(
        *S.CHUNK_KEY, "id", "section", F.md5("text").alias("digest"), "source")


@query("a8_metrics_sink")
def _(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    writers.write_metrics(metrics.classification_metrics(inputs.scored(spark, sf_dir)), path)
    return writers.read_metrics(spark, path)


def _logged(spark: SparkSession, sf_dir: str) -> str:
    """The log of one decision for each event of a user that is an applicant; one of its batches came twice."""
    asked = jobs.assess(billing.applicants(spark, sf_dir)).withColumns({
        "compliance_answer": F.lit(None).cast("string"), "compliance_sources": F.array().cast("array<string>")})
    events = readers.load(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    joined = events.join(asked, F.col("user_id") == F.col(X.KEY))
    entries = materialize(jobs.decision_log(joined, F.col("ts"), F.col("event_id")), "entries")
    path = scratch_path(spark, "decisions")
    for batch in (0, 1, 0):
        writers.append_decisions(entries.filter(F.col("id") % 2 == batch), path, f"events-{batch}")
    return path


@query("a9_decision_log")
def _(spark, sf_dir):
    return writers.read_decisions(spark, _logged(spark, sf_dir)).select(
        "id", "decided_at", F.col("decision_date").cast("string").alias("decision_date"), X.KEY,
        "risk_probability", "risk_decision", "compliance_question",
        F.col("applicant_data.utilization_ratio").alias("utilization_ratio"),
        F.col("top_risk_factors")[0]["feature"].alias("top_feature"),
    )


@query("a10_recent_decisions")
def _(spark, sf_dir):
    return writers.recent_decisions(spark, _logged(spark, sf_dir))


@query("a11_typed_requests")
def _(spark, sf_dir):
    bare = inputs.requests(spark, sf_dir).withColumn("body", readers.unfence(F.col("body")))
    parsed = readers.parse_requests(bare, "body")
    return parsed.select("request_id", "valid", *[F.col(f"request.{c}").alias(c) for c in X.BASE_COLUMNS])


@query("a12_required_fields")
def _(spark, sf_dir):
    missing = readers.missing_fields(F.col("body"))
    return inputs.requests(spark, sf_dir).select(
        "request_id", F.size(missing).alias("n_missing"), F.array_join(missing, ", ").alias("missing"))


# --- B: profiling --------------------------------------------------------------------

_on_applicants("b1_shape", profile.shape)
_on_applicants("b2_preview", profile.preview)
_on_applicants("b4_target_distribution", profile.class_distribution)


@query("b5_null_profile")
def _(spark, sf_dir):
    documents = readers.load(spark, sf_dir, "documents")
    return profile.null_profile(documents.join(readers.load(spark, sf_dir, "labels"), "doc_id", "left"))


_on_applicants("b6_describe", lambda df: profile.describe(df, ["LIMIT_BAL", "AGE"]))
_on_applicants("b7_limit_histogram", profile.class_histogram)
_on_applicants("b8_rate_by_sex", lambda df: profile.default_rate(df, "SEX"))
_on_applicants("b9_rate_by_education", lambda df: profile.default_rate(clean.recode(df), "EDUCATION").orderBy(
    F.desc("default_rate_pct"), "EDUCATION"))
_on_applicants("b10_rate_by_status", lambda df: profile.default_rate(df, "PAY_0").orderBy("PAY_0"))
_on_applicants("b11_correlation", profile.correlation)
_on_applicants("b12_dataset_summary", lambda df: profile.dataset_summary(
    materialize(df, "applicants"), [*X.BASE_COLUMNS, X.TARGET]))
_on_applicants("b12_sample_rows", lambda df: profile.sample_rows(df, [*X.BASE_COLUMNS, X.TARGET]))


# --- C: cleaning and validation --------------------------------------------------------

_on_applicants("c1_education_recode", lambda df: df.select(
    X.KEY, clean.education(F.col("EDUCATION")).alias("EDUCATION")))
_on_applicants("c2_marriage_recode", lambda df: df.select(X.KEY, clean.marriage(F.col("MARRIAGE")).alias("MARRIAGE")))
_on_applicants("c3_validation", lambda df: df.select(
    X.KEY, F.size(clean.warnings()).alias("n_warnings"), F.array_join(clean.warnings(), "; ").alias("warnings")))
_on_applicants("c4_cap_flags", lambda df: df.select(X.KEY, clean.cap_flags().alias("f")).select(X.KEY, "f.*"))
_on_applicants("c5_limit_against_caps", clean.limit_against_caps)
_on_applicants("c6_code_labels", lambda df: clean.with_labels(clean.recode(df)).select(
    X.KEY, "sex_label", "education_label", "marriage_label", "summary_line"))
_on_applicants("c7_quality_rollup", clean.quality_rollup)
_on_applicants("c7_warning_counts", clean.warning_counts)


# --- D: features --------------------------------------------------------------------------

_on_applicants("d1_row_sum", lambda df: df.select(
    X.KEY, features.months_total(X.STATUS_COLUMNS).alias("status_sum"), features.total_billed().alias("billed")))
_on_applicants("d2_avg_bill", lambda df: df.select(X.KEY, features.avg_bill_amt().alias("avg_bill_amt")))
_on_applicants("d3_utilization", lambda df: df.select(
    X.KEY, features.utilization_ratio(None).alias("training"), features.utilization_ratio(0.0).alias("serving")))
_on_applicants("d4_avg_pay_delay", lambda df: df.select(X.KEY, features.avg_pay_delay().alias("avg_pay_delay")))
_on_applicants("d5_max_pay_delay", lambda df: df.select(X.KEY, features.max_pay_delay().alias("max_pay_delay")))
_on_applicants("d6_months_late", lambda df: df.select(X.KEY, features.months_late().alias("months_late")))
_on_applicants("d7_totals", lambda df: df.select(
    X.KEY, features.total_paid().alias("total_paid_6m"), features.total_billed().alias("total_billed_6m")))
_on_applicants("d8_payment_ratio", lambda df: df.select(X.KEY, features.payment_ratio().alias("payment_ratio")))
_on_applicants("d9_delay_trend", lambda df: df.select(X.KEY, features.delay_trend().alias("delay_trend")))
_on_applicants("d10_feature_table", jobs.feature_table)
_on_applicants("d11_history_long", features.history)
_on_features("d12_engineered_table", features.engineered_table)


@query("d13_wide_history")
def _(spark, sf_dir):
    return billing.applicants(spark, sf_dir)


# --- E: splits and balance -------------------------------------------------------------------

_on_applicants("e1_stratified_split", lambda df: split.stratified_split(
    materialize(df.select(X.KEY, X.TARGET), "labels")))
_on_applicants("e2_split_report", lambda df: split.split_report(split.stratified_split(
    materialize(df.select(X.KEY, X.TARGET), "labels"))))
_on_applicants("e3_stratified_folds", lambda df: split.stratified_folds(df.select(X.KEY, X.TARGET)))
_on_applicants("e4_class_weight", split.class_weight)


@query("e1_label_split")
def _(spark, sf_dir):
    """The labelled documents: a second table, with rare positives."""
    labels = readers.load(spark, sf_dir, "labels").select("doc_id", "quality")
    return split.stratified_split(labels, label="quality", key="doc_id")


# --- F: model ----------------------------------------------------------------------------------

def _training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and row weights, written once."""
    return materialize(model.with_class_weight(materialize(inputs.features(spark, sf_dir), "features")), "training")


def _decided(scored: DataFrame, threshold: float) -> Column:
    """Whether the score is a probability and the decision is what the threshold makes of it."""
    rule = F.when(F.col("risk_probability") >= F.lit(threshold), X.REJECT).otherwise(X.APPROVE)
    return F.col("risk_probability").between(0, 1) & (F.col("risk_decision") == rule)


def _held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = materialize(split.stratified_split(materialize(inputs.features(spark, sf_dir), "features")), "parts")
    weighted = materialize(model.with_class_weight(table.filter(F.col("split") == split.TRAIN)), "training")
    fitted = boosting.train(weighted, weight=model.WEIGHT)
    return tuning.score(table.filter(F.col("split") == split.TEST), tuning.Bundle(fitted, X.DEFAULT_THRESHOLD))


@query("f1_train_boosted_trees")
def _(spark, sf_dir):
    return _held_out(spark, sf_dir).select(X.KEY, X.TARGET, "risk_probability", "risk_decision")


@query("f1_decisions")
def _(spark, sf_dir):
    """Each row of the test part has a score, and the decision that goes with it."""
    scored = _held_out(spark, sf_dir)
    return scored.select(X.KEY, X.TARGET, _decided(scored, X.DEFAULT_THRESHOLD).alias("decided"))


#: Trees of the registered search; the library's range is X.SEARCH_TREES. See README for what it costs.
SEARCH = {"n": 3, "trees": (5, 10)}


@query("f2_search")
def _(spark, sf_dir):
    return tuning.search(_training_table(spark, sf_dir), **SEARCH).report()


@query("f2_fold_sizes")
def _(spark, sf_dir):
    """What each trial's folds were scored on, and that all nine parameters lie in their ranges."""
    found = tuning.search(_training_table(spark, sf_dir), **SEARCH)
    limits = [
        ("trees", *SEARCH["trees"]), ("depth", *X.SEARCH_DEPTH), ("rate", *X.SEARCH_RATE), ("subsample", *X.SEARCH_SUBSAMPLE),
        ("columns", *X.SEARCH_COLUMN_SAMPLE), ("child_weight", *X.SEARCH_MIN_CHILD), ("gamma", *X.SEARCH_MIN_GAIN),
        ("l1", *X.SEARCH_L1), ("l2", *X.SEARCH_L2)]
    inside = sum(F.col("params")[name].cast("double").between(low, high).cast("int") for name, low, high in limits)
    return found.aucs.join(found.report(), "trial").select(
        "trial", "fold", "positives", "negatives", F.col("roc_auc").between(0, 1).alias("has_auc"), inside.alias("n_inside"))


def _out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.out_of_fold(_training_table(spark, sf_dir))


@query("f3_out_of_fold")
def _(spark, sf_dir):
    return _out_of_fold(spark, sf_dir).select(X.KEY, X.TARGET, "fold", "risk_probability")


@query("f3_fold_coverage")
def _(spark, sf_dir):
    """Which row was scored in which fold: each exactly once."""
    return _out_of_fold(spark, sf_dir).filter(F.col("risk_probability").between(0, 1)).select(X.KEY, X.TARGET, "fold")


_on_features("f4_score_and_decide", lambda df: scoring.score(df).select(X.KEY, "risk_probability", "risk_decision"))
_on_scores("f5_best_threshold", metrics.best_threshold)
_on_scores("f5_threshold_sweep", lambda df: metrics.threshold_sweep(df, metrics.sweep_thresholds()))
_on_scores("f6_threshold_table", metrics.threshold_table)
_on_scores("f7_metrics", metrics.classification_metrics)
_on_scores("f8_confusion_matrix", metrics.confusion_matrix)
_on_scores("f9_roc_auc", metrics.roc_auc)
_on_scores("f10_naive_baseline", metrics.naive_baseline)


def _bundle(spark: SparkSession, table: DataFrame) -> tuple[boosting.Boosted, str]:
    """A trained model, saved with one threshold and then given another."""
    fitted, path = boosting.train(table, weight=model.WEIGHT), scratch_path(spark, "bundle")
    tuning.save_bundle(spark, fitted, X.FALLBACK_THRESHOLD, path)
    model.set_threshold(spark, X.DEFAULT_THRESHOLD, path)
    return fitted, path


@query("f11_model_bundle")
def _(spark, sf_dir):
    table = _training_table(spark, sf_dir)
    _, path = _bundle(spark, table)
    return tuning.score(table, tuning.load_bundle(spark, path)).select(X.KEY, "risk_probability", "risk_decision")


@query("f11_bundle_round_trip")
def _(spark, sf_dir):
    """A saved and loaded model scores like the one in memory; the new threshold is in force."""
    table = _training_table(spark, sf_dir)
    fitted, path = _bundle(spark, table)
    loaded = tuning.load_bundle(spark, path)
    before = tuning.score(table, tuning.Bundle(fitted, X.FALLBACK_THRESHOLD)).select(X.KEY, F.col("risk_probability").alias("before"))
    after = tuning.score(table, loaded).select(X.KEY, F.col("risk_probability").alias("after"))
    return before.join(after, X.KEY).agg(
        F.count(F.lit(1)).alias("n_applicants"), F.count_if(F.col("before") != F.col("after")).alias("n_different"),
    ).withColumn("threshold", F.lit(loaded.threshold))


# --- G: attribution ----------------------------------------------------------------------------------

def _tree_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _training_table(spark, sf_dir)
    bundle = tuning.Bundle(boosting.train(table, weight=model.WEIGHT), X.DEFAULT_THRESHOLD)
    return tuning.contributions(tuning.score(table, bundle), bundle)


def _off() -> Column:
    """Whether base value and contributions miss the log-odds of the score."""
    total = F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda acc, c: acc + c["impact"])
    return F.abs(F.lit(1.0) / (F.lit(1.0) + F.exp(-total)) - F.col("risk_probability")) > 1e-4


@query("g1_tree_contributions")
def _(spark, sf_dir):
    return _tree_explained(spark, sf_dir).select(X.KEY, "risk_probability", "base_value", F.inline("contributions"))


@query("g1_contributions_add_up")
def _(spark, sf_dir):
    """Base value plus contributions are the log-odds of every score."""
    return _tree_explained(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_applicants"), F.count_if(_off()).alias("n_off"))


_on_contributions("g2_linear_contributions", explain.contribution_rows)


@query("g3_base_value")
def _(spark, sf_dir):
    return _tree_explained(spark, sf_dir).select("base_value").distinct()


_on_contributions("g4_top_factors", lambda df: explain.factor_rows(
    df, explain.top_factors(F.col("contributions"), X.TOP_CHART)))
_on_contributions("g5_global_importance", explain.global_importance)
_on_contributions("g6_category_impact", explain.category_impact)
_on_scores("g7_extremes", explain.extremes)
_on_contributions("g8_direction", lambda df: explain.factor_rows(
    df, explain.top_factors(F.col("contributions"), X.TOP_REPORT)).select(
    X.KEY, "rank", explain.display_name(F.col("feature")).alias("display_name"),
    explain.direction(F.col("impact")).alias("direction")))
_on_contributions("g9_summary_points", lambda df: explain.contribution_rows(df).select("feature", "value", "impact"))


# --- H: documents and retrieval ---------------------------------------------------------------------------

@query("h1_sections")
def _(spark, sf_dir):
    return corpus.sections(inputs.corpus(spark, sf_dir)).select(
        "doc_id", "ord", "header", F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunk(inputs.corpus(spark, sf_dir))


@query("h2_intro_windows")
def _(spark, sf_dir):
    """Plain documents have no heading: each is an introduction of its own."""
    plain = readers.load(spark, sf_dir, "documents").select("doc_id", "text")
    return corpus.chunk(plain).select("doc_id", "part", "id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("h3_section_windows")
def _(spark, sf_dir):
    return _chunks(spark, sf_dir).filter("ord > 0").select(
        *S.CHUNK_KEY, F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("h4_chunk_labels")
def _(spark, sf_dir):
    return _chunks(spark, sf_dir).select(*S.CHUNK_KEY, "id", "section", "source")


def _conversation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


@query("h5_hashed_vectors")
def _(spark, sf_dir):
    return vectors.weights(vectors.with_counts(_conversation_texts(spark, sf_dir)), ["conv_id", "turn"])


@query("h6_vectors_for_table")
def _(spark, sf_dir):
    """Given vectors as they are, hashed ones for plain texts."""
    given = readers.load(spark, sf_dir, "embeddings").select(F.concat(F.lit("e"), "vec_id").alias("key"), "embedding")
    texts = readers.load(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("key"), "text")
    both = vectors.vectors_for(given, vector="embedding").select("key", "vector").unionByName(
        vectors.vectors_for(texts).select("key", "vector"))
    return both.select("key", F.posexplode_outer("vector").alias("dim", "v")).filter("v <> 0").select(
        "key", "dim", F.round(F.col("v").cast("double"), 5).alias("weight"))


@query("h7_nearest_vectors")
def _(spark, sf_dir):
    store = readers.load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = store.select(F.col("vec_id").alias("question_id"), "embedding")
    return nearest(asked, store, X.TOP_K_AGENT, question_key="question_id", store_key=["vec_id"],
                   question_vector="embedding", store_vector="embedding", normalise=False)


@query("h7_nearest_chunks")
def _(spark, sf_dir):
    return retrieve.nearest_chunks(
        inputs.benchmark_questions(spark, sf_dir), jobs.scratch_store(inputs.corpus(spark, sf_dir)))


@query("h8_requested_regulation")
def _(spark, sf_dir):
    return inputs.questions(spark, sf_dir).select(
        "question_id", *[c.alias(n) for n, c in retrieve.requested_regulation(F.col("question")).items()])


@query("h9_exact_lookup")
def _(spark, sf_dir):
    chunks = jobs.scratch_chunks(inputs.corpus(spark, sf_dir))
    return retrieve.exact_lookup(inputs.questions(spark, sf_dir), retrieve.regulation_parts(chunks)).select(
        "question_id", "rank", *S.CHUNK_KEY, "section", F.md5("text").alias("digest"))


def _hybrid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = inputs.questions(spark, sf_dir)
    store = jobs.scratch_store(inputs.corpus(spark, sf_dir))
    return asked, store, retrieve.hybrid(asked, store)


@query("h10_hybrid_route")
def _(spark, sf_dir):
    _, _, found = _hybrid(spark, sf_dir)
    return found.select("question_id", "route", "rank", *S.CHUNK_KEY, "section", "distance")


@query("h11_overview")
def _(spark, sf_dir):
    chunks = jobs.scratch_chunks(inputs.corpus(spark, sf_dir))
    found = retrieve.answer_overviews(inputs.questions(spark, sf_dir), chunks)
    return found.select("question_id", "answer", F.array_join("sources", "; ").alias("sources"))


@query("h12_applicant_question")
def _(spark, sf_dir):
    return jobs.assess(billing.applicants(spark, sf_dir)).select(X.KEY, "compliance_question")


@query("h13_context")
def _(spark, sf_dir):
    found = retrieve.answers(_hybrid(spark, sf_dir)[2])
    return found.select("question_id", F.length("context").alias("n_chars"), F.md5("context").alias("digest"))


@query("h14_sources")
def _(spark, sf_dir):
    found = retrieve.answers(_hybrid(spark, sf_dir)[2])
    return found.select("question_id", F.array_join("sources", "; ").alias("sources"))


@query("h15_title_match")
def _(spark, sf_dir):
    asked = inputs.title_questions(spark, sf_dir)
    store = jobs.scratch_store(inputs.corpus(spark, sf_dir))
    near = retrieve.attach_chunks(retrieve.nearest_chunks(asked, store), store)
    return retrieve.with_title_match(near, asked, store).select(
        "question_id", "rank", *S.CHUNK_KEY, "section", "distance")


@query("h16_citation_check")
def _(spark, sf_dir):
    doc = F.col("doc_id")
    sources = F.array(
        F.concat(F.lit("REGULATION R-"), (1 + doc % 7).cast("string")),
        F.concat(F.lit("Regulation O-"), (1 + doc % 16).cast("string"), F.lit(" (Part 2)")),
    )
    missing = retrieve.unsupported_citations(F.col("text"), sources)
    return inputs.corpus(spark, sf_dir).select(
        "doc_id", (F.size(missing) == 0).alias("supported"), F.array_join(F.array_sort(missing), "; ").alias("unsupported"))


# --- I and J: reports and whole jobs ---------------------------------------------------------------------------

def _underwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = jobs.scratch_store(inputs.corpus(spark, sf_dir))
    return jobs.underwrite(materialize(billing.applicants(spark, sf_dir), "applicants"), store)


@query("i1_report")
def _(spark, sf_dir):
    return _underwritten(spark, sf_dir).select(X.KEY, "final_report")


@query("i2_memo_facts")
def _(spark, sf_dir):
    asked = jobs.assess(billing.applicants(spark, sf_dir))
    return asked.select(X.KEY, memo_facts(
        F.col("risk_decision"), F.col("risk_probability"), F.col("top_risk_factors"), F.col("compliance_question"),
    ).alias("memo_facts"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _underwritten(spark, sf_dir).select(
        X.KEY, F.array_join("data_warnings", "; ").alias("data_warnings"),
        F.col(f"cap_flags.{X.FLAG_CLEAN}").alias(X.FLAG_CLEAN),
        F.col(f"cap_flags.{X.FLAG_AGGREGATE}").alias(X.FLAG_AGGREGATE),
        *X.ENGINEERED_COLUMNS, "risk_probability", "risk_decision",
        F.array_join(F.transform("top_risk_factors", lambda f: f["feature"]), ", ").alias("top_risk_factors"),
        "compliance_question", F.array_join("compliance_sources", "; ").alias("compliance_sources"),
        F.md5("final_report").alias("report_digest"),
    )


QUERIES["j1_portfolio_underwriting"] = flagship


@query("j1_citation_check")
def _(spark, sf_dir):
    """Regulations that a report cites and its sources do not have."""
    return _underwritten(spark, sf_dir).select(
        X.KEY, (F.size("unsupported") == 0).alias("supported"), F.array_join(F.array_sort("unsupported"), "; ").alias("unsupported"))


@query("j1_underwriting_by_model")
def _(spark, sf_dir):
    """The same job with a trained bundle: every decision is the rule's, every attribution adds up."""
    people = materialize(billing.applicants(spark, sf_dir), "applicants")
    _, path = _bundle(spark, _training_table(spark, sf_dir))
    bundle = tuning.load_bundle(spark, path)
    store = jobs.scratch_store(inputs.corpus(spark, sf_dir))
    decided = jobs.underwrite(people, store, bundle)
    return decided.select(
        X.KEY, F.array_join("data_warnings", "; ").alias("data_warnings"), *X.ENGINEERED_COLUMNS,
        _decided(decided, X.DEFAULT_THRESHOLD).alias("decided"), (~_off()).alias("adds_up"),
        F.size("top_risk_factors").alias("n_factors"), (F.size("compliance_sources") > 0).alias("answered"))


def _arriving(spark: SparkSession, people: DataFrame, folder: str, half: int | None = None) -> None:
    rows = people if half is None else people.filter(F.col(X.KEY) % 2 == half)
    rows.select(
        F.col(X.KEY).alias("request_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("request_ts"),
        X.KEY, *X.BASE_COLUMNS).repartition(X.KEY).write.mode("append").parquet(folder)


@query("j2_streaming_underwriting")
def _(spark, sf_dir):
    people = materialize(billing.applicants(spark, sf_dir), "applicants")
    folder, log = scratch_path(spark, "requests"), scratch_path(spark, "stream-log")
    _arriving(spark, people, folder)
    running = stream.underwrite_stream(
        stream.read_requests(spark, folder), jobs.scratch_store(inputs.corpus(spark, sf_dir)), log,
        scratch_path(spark, "stream-checkpoint"), jobs.portfolio_means(people))
    running.awaitTermination()
    return stream.read_log(spark, log).select(
        "id", X.KEY, "risk_probability", "risk_decision", "compliance_question",
        F.array_join("compliance_sources", "; ").alias("compliance_sources"))


@query("j2_streaming_by_model")
def _(spark, sf_dir):
    """A stream with a saved model. The threshold is replaced between two batches and holds for the second."""
    people = materialize(billing.applicants(spark, sf_dir), "applicants")
    fitted, path = boosting.train(_training_table(spark, sf_dir), weight=model.WEIGHT), scratch_path(spark, "bundle")
    tuning.save_bundle(spark, fitted, X.FALLBACK_THRESHOLD, path)
    folder, log, seen = (scratch_path(spark, name) for name in ("requests", "stream-log", "stream-checkpoint"))
    store = jobs.scratch_store(inputs.corpus(spark, sf_dir))
    thresholds = (X.FALLBACK_THRESHOLD, X.DEFAULT_THRESHOLD)
    for half, threshold in enumerate(thresholds):
        if half:
            model.set_threshold(spark, threshold, path)
        _arriving(spark, people, folder, half)
        stream.underwrite_stream(
            stream.read_requests(spark, folder), store, log, seen, bundle_path=path).awaitTermination()
    entries = stream.read_log(spark, log)
    right = [F.when(F.col(X.KEY) % 2 == half, _decided(entries, threshold)) for half, threshold in enumerate(thresholds)]
    return entries.select("id", X.KEY, F.coalesce(*right).alias("decided"), F.col("batch_id"), F.size("top_risk_factors").alias("n_factors"))


@query("j3_feature_job")
def _(spark, sf_dir):
    path = scratch_path(spark, "features")
    jobs.feature_job(billing.applicants(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("j4_corpus_job")
def _(spark, sf_dir):
    documents, path = inputs.corpus(spark, sf_dir), scratch_path(spark, "store")
    jobs.corpus_job(documents, path)
    kept = jobs.corpus_job(documents, path)  # present: not built again
    words = F.aggregate("counts", F.lit(0), lambda acc, c: acc + c)
    return kept.select(*S.CHUNK_KEY, "id", "section", F.md5("text").alias("digest"), words.alias("n_words"))


@query("j5_profile_job")
def _(spark, sf_dir):
    return jobs.profile_summary(jobs.profile_job(materialize(billing.applicants(spark, sf_dir), "applicants")))


@query("j6_training_job")
def _(spark, sf_dir):
    """Class weight, threshold, final model, metrics and bundle from the written feature table, at the library's parameters."""
    path = scratch_path(spark, "features")
    jobs.feature_job(billing.applicants(spark, sf_dir).filter("LIMIT_BAL <> 0"), path)
    trained = training.training_job(spark.read.parquet(path), scratch_path(spark, "model"), boosting.Params())
    scored = F.col("risk_probability").between(0, 1)
    part = F.lit(split.TRAIN)
    held = trained.held_out
    return trained.out_of_fold.select(X.KEY, X.TARGET, part.alias("split"), "fold", scored.alias("decided")).unionByName(
        held.select(X.KEY, X.TARGET, F.lit(split.TEST).alias("split"), F.lit(None).cast("int").alias("fold"),
                    _decided(held, trained.bundle.threshold).alias("decided")))


@query("j7_explain_job")
def _(spark, sf_dir):
    """Attribution of the test part by the trained model: one row per applicant and feature, told by what it does."""
    table = materialize(split.stratified_split(materialize(inputs.features(spark, sf_dir), "features")), "parts")
    weighted = materialize(model.with_class_weight(table.filter(F.col("split") == split.TRAIN)), "training")
    bundle = tuning.Bundle(boosting.train(weighted, weight=model.WEIGHT), X.DEFAULT_THRESHOLD)
    told = training.explain_job(table.filter(F.col("split") == split.TEST), bundle)
    return told["points"].select(X.KEY, "feature", "value")


@query("j8_question_job")
def _(spark, sf_dir):
    found = jobs.question_job(inputs.title_questions(spark, sf_dir), jobs.scratch_store(inputs.corpus(spark, sf_dir)))
    return found.select("question_id", F.length("context").alias("n_chars"), F.md5("context").alias("digest"),
                        F.array_join("sources", "; ").alias("sources"))
