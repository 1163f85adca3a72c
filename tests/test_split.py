import hashlib

import pytest
from pyspark.sql import functions as F

from creditloom.operators import split


@pytest.fixture(scope="module")
def rows(spark):
    # One class holds most rows; a null class is a class as well.
    label = F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 37 == 5, None).otherwise(0)
    return spark.range(5000).select(F.col("id").alias("applicant_id"), label.alias("target"))


def expected_order(pairs):
    return sorted(pairs, key=lambda p: (hashlib.md5(f"{p}:42".encode()).hexdigest(), p))


def by_class(rows):
    classes = {}
    for r in rows.collect():
        classes.setdefault(r["target"], []).append(r["applicant_id"])
    return classes


def test_split_is_exact_per_class_and_complete(rows):
    got = {r["applicant_id"]: r["split"] for r in split.stratified_split(rows).collect()}
    assert len(got) == rows.count()
    for members in by_class(rows).values():
        wanted = expected_order(members)
        size = int(0.2 * len(members) + 0.5)
        assert {m for m in members if got[m] == "test"} == set(wanted[:size])


def test_folds_are_dealt_out_in_hash_order(rows):
    got = {r["applicant_id"]: r["fold"] for r in split.stratified_folds(rows).collect()}
    assert len(got) == rows.count()
    for members in by_class(rows).values():
        assert [got[m] for m in expected_order(members)] == [i % 5 for i in range(len(members))]


def test_another_seed_gives_another_split(rows):
    a = split.stratified_split(rows, seed=1).filter("split = 'test'").select("applicant_id")
    b = split.stratified_split(rows, seed=2).filter("split = 'test'").select("applicant_id")
    assert a.subtract(b).count() > 0


def test_tiny_classes(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "applicant_id long, target int")
    assert split.stratified_split(df).filter("split = 'test'").count() == 0


def test_class_weight_without_positives(spark):
    df = spark.createDataFrame([(1, 0)], "applicant_id long, target int")
    assert split.class_weight(df).first()["scale_pos_weight"] is None
