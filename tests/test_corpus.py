import numpy as np
from pyspark.sql import functions as F

from creditloom import fixed as X
from creditloom.functions.text import blocks, strip, windows_of, words
from creditloom.operators import vectors
from creditloom.operators.corpus import chunk, sections
from creditloom.sources.readers import cut_front_matter


def chunks(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return chunk(df).orderBy("doc_id", "ord", "part").collect()


def test_body_lengths_around_the_window(spark):
    head = "REGULATION R-1\n"
    for length, parts in ((2000, 1), (2001, 2), (3640, 2), (3660, 3)):
        rows = chunks(spark, head + "x" * length)
        assert len(rows) == parts, length
    rows = chunks(spark, head + "x" * 2001)
    assert [r["id"] for r in rows] == ["regulation_r_1_part_1", "regulation_r_1_part_2"]
    assert rows[1]["section"] == "REGULATION R-1 (Part 2)"
    assert rows[1]["text"] == "REGULATION R-1\n" + "x" * 201


def test_intro_tails(spark):
    assert len(chunks(spark, "y" * 1900)) == 1  # the tail has exactly 100 characters
    rows = chunks(spark, "y" * 1901)
    assert [r["id"] for r in rows] == ["intro_0", "intro_1"] and rows[1]["section"] == X.INTRO_SECTION


def test_empty_parts_and_repeated_headings(spark):
    rows = chunks(spark, "REGULATION R-1REGULATION  O-2 body REGULATION R-1\nagain", "", None)
    assert [(r["doc_id"], r["ord"], r["section"], r["text"]) for r in rows] == [
        (0, 1, "REGULATION R-1", "REGULATION R-1\n"),
        (0, 2, "REGULATION  O-2", "REGULATION  O-2\nbody"),
        (0, 3, "REGULATION R-1", "REGULATION R-1\nagain"),
    ]
    assert rows[1]["id"] == "regulation__o_2"


def test_headings_are_case_sensitive(spark):
    df = spark.createDataFrame([(0, "regulation r-1 REGULATION X-1 REGULATION R-7")], "doc_id long, text string")
    assert [r["header"] for r in sections(df).orderBy("ord").collect()] == [None, "REGULATION R-7"]


def test_windows_equal_slices(spark):
    text = "".join(chr(0x1F600 + i % 40) if i % 7 == 0 else chr(97 + i % 26) for i in range(997))
    df = spark.createDataFrame([(text,)], "t string")
    for size, overlap in ((100, 20), (90, 60), (50, 0)):
        step = size - overlap
        got = df.select(blocks(F.col("t"), step).alias("p")).select(windows_of(F.col("p"), size, overlap).alias("w")).first()["w"]
        assert got == [text[i:i + size] for i in range(0, len(text), step)]


def test_white_space_is_the_same_as_in_python(spark):
    odd = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0      　"
    text = odd + "Ab" + odd + "ÇD​e" + odd
    row = spark.createDataFrame([(text,), (odd,), ("",)], "t string").select(
        strip(F.col("t")).alias("s"), words(F.col("t")).alias("w")).collect()
    assert [r["s"] for r in row] == [text.strip(), "", ""]
    assert [r["w"] for r in row] == [text.lower().split(), [], []]


def test_front_matter(spark):
    texts = [(f"a{X.FRONT_MATTER_END}b{X.FRONT_MATTER_END}c",), ("plain",), (X.FRONT_MATTER_END,)]
    got = spark.createDataFrame(texts, "t string").select(cut_front_matter(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in got] == [f"b{X.FRONT_MATTER_END}c", "plain", ""]


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(0, "Cash cash LOAN"), (1, ""), (2, None)], "k long, text string")
    rows = vectors.with_counts(df).withColumn("unit", vectors.unit(F.col("counts"))).orderBy("k").collect()
    assert sorted(c for c in rows[0]["counts"] if c) == [1, 2]
    assert len(rows[0]["counts"]) == X.VECTOR_SIZE
    assert np.isclose(np.linalg.norm(rows[0]["unit"]), 1.0)
    assert not any(rows[1]["counts"]) and not any(rows[2]["unit"])
