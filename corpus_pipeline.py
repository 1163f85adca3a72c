"""From raw documents to packed training tokens, one operator per stage.

Every stage begins with a collection on the executors, so that the memory of one
stage does not add to that of the next. Null and empty texts go in the first
stage, as they have no letter; null keys, repeated rows and other columns are
handled as each operator's docstring says; an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from creditloom.llm import decontaminate, language, mixing, simhash, token_files
from creditloom.llm.parts import bound_batches, settle
from creditloom.llm.queries import BYTE_BPE, END_ID, VOCABULARY, WEIGHTS, mixture_levels, read
from creditloom.session import materialize, scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; a short one has a low score by nature and stays."""
    settle(spark)
    bound_batches(spark)
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: 4-word shingles, 4 bits."""
    settle(spark)
    bound_batches(spark)
    return simhash.keep_one(docs, simhash.SHINGLE, simhash.DISTANCE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a twentieth or more of benchmark spans go."""
    settle(spark)
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, by the target weights; a document may come several times or not at all."""
    settle(spark)
    return mixing.take_mixture(docs, mixture_levels(), WEIGHTS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Binary shards below the shared folder; what is returned is read back from them."""
    settle(spark)
    bound_batches(spark, "200", "4m")
    folder = scratch_path(spark, "corpus-tokens")
    token_files.write_token_files(docs, folder, public_tokenizers.path(BYTE_BPE), END_ID, VOCABULARY)
    return token_files.read_token_files(spark, folder)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]
#: Fingerprints, learnt profiles and token ids can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each one's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
