"""Stratified split, folds and class weight.

Rows are ordered by a hash of key and seed. An exact cut per class normally
means ranking a whole class in one task; here the classes are first counted per
hash bucket, so that only one bucket per class has to be ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions.running import numbered
from ..session import materialize

BUCKET_DIGITS = 5  # hex digits: 16**5 buckets, whatever the number of rows
TRAIN, TEST = "train", "test"


def shuffle_order(key: str, seed: int) -> Column:
    """A reproducible pseudo-random order over the rows."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)))


def _bucket(order: Column) -> Column:
    return F.left(order, F.lit(BUCKET_DIGITS))


def _bucket_offsets(rows: DataFrame) -> DataFrame:
    """Rows per (class, bucket) and rows of the class in earlier buckets."""
    counts = rows.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("label")
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "label", "bucket", "n",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("n_class"),
    )


def stratified_split(
    df: DataFrame, label: str = X.TARGET, key: str = X.KEY, test_share: float = X.TEST_SHARE, seed: int = X.SEED
) -> DataFrame:
    """Adds `split`; every class gives exactly round(test_share * n) rows to the test part.

    Rows meet one cut point per class. The cut points are written first, so their
    size is known: few classes are broadcast and the rows stay where they are.
    """
    order = shuffle_order(key, seed)
    rows = df.select(F.col(label).alias("label"), F.col(key).alias("row_key"), order.alias("order"))
    # Class, key and hash only, written once: they are counted, and then ranked in one bucket per class.
    rows = materialize(rows.withColumn("bucket", _bucket(F.col("order"))), "order")
    wanted = F.round(F.lit(test_share) * F.col("n_class")).cast("long")
    cut_buckets = (
        _bucket_offsets(rows).withColumn("wanted", wanted)
        .filter((F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("before") + F.col("n")))
        .select(F.col("label").alias("cut_label"), F.col("bucket").alias("cut_bucket"),
                (F.col("wanted") - F.col("before")).alias("take"))
    )
    in_bucket = Window.partitionBy("label").orderBy("order", "row_key")
    same_bucket = F.col("label").eqNullSafe(F.col("cut_label")) & (F.col("bucket") == F.col("cut_bucket"))
    cuts = (
        rows.join(materialize(cut_buckets, "cut-buckets"), same_bucket)
        .withColumn("rank", F.row_number().over(in_bucket))
        .filter(F.col("rank") == F.col("take"))
        .select(F.col("label").alias("cut_label"), F.struct("order", "row_key").alias("cut"))
    )
    own = F.struct(order.alias("order"), F.col(key).alias("row_key"))
    return df.join(materialize(cuts, "cuts"), F.col(label).eqNullSafe(F.col("cut_label")), "left").select(
        *df.columns, F.when(own <= F.col("cut"), TEST).otherwise(TRAIN).alias("split")
    )


def split_report(df: DataFrame, label: str = X.TARGET) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col(label).cast("long")) / F.count(label) * 100, 1).alias("default_pct"),
    )


def stratified_folds(
    df: DataFrame, label: str = X.TARGET, key: str = X.KEY, k: int = X.FOLDS, seed: int = X.SEED
) -> DataFrame:
    """Adds `fold` 0..k-1, dealt out in hash order within each class.

    Rows are dealt out once, by ranges of class and hash; a row's place in its
    class is its number less the number of the class' first row. Equal keys
    follow each other in any order.
    """
    place, first = "_place", "_first"
    rows = numbered(df.withColumn("_order", shuffle_order(key, seed)), [label, "_order", key], place)
    starts = rows.groupBy(F.col(label).alias("_label")).agg(F.min(place).alias(first))  # one row per class
    same = F.col(label).eqNullSafe(F.col("_label"))
    return rows.join(materialize(starts, "starts"), same).select(
        *df.columns, ((F.col(place) - F.col(first)) % k).cast("int").alias("fold"))


def class_weight(df: DataFrame, label: str = X.TARGET) -> DataFrame:
    negatives, positives = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(
        negatives.alias("negatives"), positives.alias("positives"),
        F.round(F.try_divide(negatives.cast("double"), positives.cast("double")), 6).alias("scale_pos_weight"),
    )
