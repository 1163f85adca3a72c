"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import fixed as X
from creditloom.operators.score import score
from creditloom.plans.billing import applicants
from creditloom.plans.jobs import feature_table
from creditloom.sources.readers import cut_front_matter, load

R_COUNT, O_COUNT = 21, 8


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as they are scored: a limit of 0 counts as unused."""
    return feature_table(applicants(spark, sf_dir), empty_limit=0.0)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(features(spark, sf_dir))


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with front matter (English ones) and two regulation headings each."""
    text, doc = F.col("text"), F.col("doc_id")
    headed = F.concat(
        F.substring(text, 1, 150), F.lit("\nREGULATION R-"), (1 + doc % R_COUNT).cast("string"), F.lit("\n"),
        F.substring(text, 151, 2500), F.lit("\nREGULATION O-"), (1 + doc % O_COUNT).cast("string"), F.lit("\n"),
        F.substring(text, F.lit(2651), F.length(text)),
    )
    front = F.concat(F.lit("Preface of "), F.col("source"), F.lit(X.FRONT_MATTER_END))
    return load(spark, sf_dir, "documents").select(
        doc, F.when(F.col("lang") == "en", F.concat(front, headed)).otherwise(headed).alias("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_corpus(spark, sf_dir).withColumn("text", cut_front_matter(F.col("text")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a question; most forms name a regulation in front."""
    n, text = (1 + F.col("conv_id") % 25).cast("string"), F.col("text")
    forms = [
        F.concat(F.lit("What does Regulation R-"), n, F.lit(" say? "), text),
        F.concat(F.lit("Explain regulation r "), n, F.lit(". "), text),
        F.concat(F.lit("R0"), n, F.lit(" "), text),
        F.concat(F.lit("What is O-"), n, F.lit("? "), text),
        F.concat(F.lit("R_"), n, F.lit(" "), text),
        F.concat(F.lit("XR-"), n, F.lit(" is no regulation. "), text),
        F.concat(F.lit("How many regulations are there? "), text),
        F.concat(F.lit("What are the regulations on "), text),
        text,
        F.when(F.col("turn") % 2 == 0, F.lit("")),
    ]
    form = (F.col("conv_id") * 3 + F.col("turn")) % len(forms)
    chosen = F.lit(None).cast("string")
    for at, words in enumerate(forms):
        chosen = F.when(form == at, words).otherwise(chosen)
    return load(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("question_id"), chosen.alias("question"))


def title_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short questions that may be part of a section title."""
    n = (1 + F.col("conv_id") % 25).cast("string")
    forms = [
        F.concat(F.lit(" regulation r-"), n),
        F.concat(F.lit("R-"), n, F.lit(" (part 2)")),
        F.lit("Definitions \n"),
        F.concat(F.lit("o-"), n),
        F.col("text"),
        F.lit("  "),
    ]
    form = (F.col("conv_id") + F.col("turn")) % len(forms)
    chosen = F.lit(None).cast("string")
    for at, words in enumerate(forms):
        chosen = F.when(form == at, words).otherwise(chosen)
    return load(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("question_id"), chosen.alias("question"))


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON requests: whole applicants, applicants without some fields, and event properties."""
    people = applicants(spark, sf_dir)
    fields = []
    for at, name in enumerate(X.BASE_COLUMNS):
        # A null field is left out of the JSON text: every 7th applicant lacks one or two.
        drop = (F.col(X.KEY) % 7 == 0) & (F.col(X.KEY) % 23 == at)
        fields.append(F.when(~drop, F.col(name)).alias(name))
    body = F.concat(F.lit("```json\n"), F.to_json(F.struct(*fields)), F.lit("\n```"))
    events = load(spark, sf_dir, "events")
    return people.select(F.concat(F.lit("a"), X.KEY).alias("request_id"), body.alias("body")).unionByName(
        events.select(F.concat(F.lit("e"), "event_id").alias("request_id"), F.col("props").alias("body")))
