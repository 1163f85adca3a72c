"""Regulation text to chunks. Row-wise up to the final explode: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed as X
from .. import schemas as S
from ..functions.text import blocks, strip, windows_of


def sections(documents: DataFrame) -> DataFrame:
    """(doc_id, ord, header, body): ord 0 is what stands before the first heading."""
    split = documents.select(
        "doc_id",
        F.split("text", X.HEADING_PATTERN).alias("bodies"),
        F.regexp_extract_all("text", F.lit(X.HEADING_PATTERN), F.lit(0)).alias("headers"),
    )
    # The outer form keeps the optimizer from splitting every text a second time
    # to find out which are empty.
    rows = split.select("doc_id", "headers", F.posexplode_outer("bodies").alias("ord", "body")).filter("ord IS NOT NULL")
    header = F.when(F.col("ord") > 0, F.get("headers", F.col("ord") - 1))
    return rows.select("doc_id", "ord", header.alias("header"), strip(F.col("body")).alias("body"))


def _kept(segments: Column, longer_than: int) -> Column:
    return F.filter(F.transform(segments, strip), lambda s: F.length(s) > longer_than)


def chunk(documents: DataFrame, size: int = X.CHUNK_SIZE, overlap: int = X.CHUNK_OVERLAP) -> DataFrame:
    """Chunks with a stable key (doc_id, ord, part).

    `part` counts the kept windows of one section: from 0 for the introduction,
    from 1 for a regulation in several parts, and 0 for one that fits a chunk.
    """
    is_intro = F.col("ord") == 0
    is_short = ~is_intro & (F.length("body") <= size)
    # Cut long texts once and name the pieces, so that no later step cuts again.
    cut = sections(documents).withColumn("pieces", F.when(~is_short, blocks(F.col("body"), size - overlap)))
    segments = windows_of(F.col("pieces"), size, overlap)
    kept = (
        F.when(is_short, F.array("body"))
        .when(is_intro, _kept(segments, X.MIN_INTRO_CHARS))
        .otherwise(_kept(segments, X.MIN_PART_CHARS))
    )
    rows = cut.select("doc_id", "ord", "header", is_short.alias("short"), F.posexplode_outer(kept).alias("at", "segment"))
    rows = rows.filter("at IS NOT NULL")
    intro, at = F.col("ord") == 0, F.col("at")
    part = F.when(intro | F.col("short"), at).otherwise(at + 1)
    base_id = F.translate(F.lower("header"), " -", "__")
    several = ~intro & ~F.col("short")
    return rows.select(
        F.col("doc_id"), F.col("ord"), part.alias("part"),
        F.when(intro, F.concat(F.lit("intro_"), at.cast("string")))
        .when(several, F.concat(base_id, F.lit("_part_"), part.cast("string")))
        .otherwise(base_id).alias("id"),
        F.when(intro, X.INTRO_SECTION)
        .when(several, F.concat("header", F.lit(" (Part "), part.cast("string"), F.lit(")")))
        .otherwise(F.col("header")).alias("section"),
        F.when(intro, F.col("segment")).otherwise(F.concat("header", F.lit("\n"), "segment")).alias("text"),
        F.lit(X.CITATION).alias("source"),
    ).select(*S.CHUNK.fieldNames())
