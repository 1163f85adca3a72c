"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from . import (
    chat, decontaminate, language, lattice, mixing, neighbours, phrases, privacy, simhash, token_counts, token_files, topk, variants)
from .parts import bound_batches
from .sql import COLLOCATIONS, CONTAMINATION, MIXTURE, TOP_K

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
VOCABULARY, END_ID = 50257, 2
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE = {
    "op8_winnowed_contamination": CONTAMINATION, "op10_source_mixture": MIXTURE, "op12_phrase_collocations": COLLOCATIONS,
    "op13_threshold_top_k": TOP_K,
}

#: The tree of the mixture: what a source is, its language, the source.
WEIGHTS = {"web": 5, "books": 3, "code": 2, "web/en": 3, "books/en": 2, "web/en/src0": 2}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mixture_levels() -> dict[str, Column]:
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int") % 3
    domain = F.when(number == 0, "web").when(number == 1, "books").when(number == 2, "code").otherwise("other")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


@query
def op1_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


@query
def op2_adaptive_scan_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0)


@query
def op3_packed_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(
        read(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_BPE), END_ID, VOCABULARY)
    return token_files.read_token_files(spark, folder)


@query
def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = public_tokenizers.path(BYTE_BPE)
    formatted = chat.windows(turns, lambda: token_counts.MergeCounter(path).counts)
    return chat.read_back(materialize(formatted, "windows"))


@query
def op6_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


@query
def op7_disclosure_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.report(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", privacy.digest(F.col("base")).alias("base_sha256"), "spans", "n_term")


@query
def op8_winnowed_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


@query
def op9_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.likelihood(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@query
def op10_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"), mixture_levels(), WEIGHTS)


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(read(spark, sf_dir, "documents"), lose=199)


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


@query
def op13_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
