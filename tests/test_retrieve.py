import pytest
from pyspark.sql import functions as F

from creditloom import fixed as X
from creditloom.operators import retrieve
from creditloom.plans.jobs import answer_questions, chunk_store

QUESTIONS = {
    "What does Regulation R-8 say?": ("R", 8), "Explain Regulation R-3": ("R", 3), "R3": ("R", 3), "r 03": ("R", 3),
    "What is O-2?": ("O", 2), "R_8": ("R", 8), "R-99": ("R", 99), "XR-3": None, "R-3b": None,
    "How many regulations are there?": None, "What are the regulations?": None,
    "What is the maximum tenure for auto financing?": None, "": None, None: None,
    "R-99999999999999999999": None,
}


@pytest.fixture(scope="module")
def store(spark):
    text = "General terms. " * 10 + "\nREGULATION R-1\nlimits on cars\nREGULATION R-10\n" + "word " * 600 \
        + "\nREGULATION O-2\ncomplaints and cards"
    again = "REGULATION R-1\nanother document repeats the heading"
    return chunk_store(spark.createDataFrame([(2, again), (1, text)], "doc_id long, text string")).cache()


def ask(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "question_id string, question string")


def test_requested_regulation(spark):
    rows = ask(spark, *QUESTIONS).select("question", *[
        c.alias(n) for n, c in retrieve.requested_regulation(F.col("question")).items()]).collect()
    for r in rows:
        got = (r["letter"], r["number"]) if r["number"] is not None else None
        assert got == QUESTIONS[r["question"]], r["question"]
        assert r["number"] is not None or r["letter"] is None


def test_exact_lookup_takes_all_parts_of_the_first_section(spark, store):
    parts = retrieve.regulation_parts(store)
    rows = retrieve.exact_lookup(ask(spark, "R-1", "R-10", "R-5"), parts).orderBy("question_id", "rank").collect()
    assert [(r["question_id"], r["rank"], r["doc_id"], r["section"]) for r in rows] == [
        ("0", 1, 1, "REGULATION R-1"),
        ("1", 1, 1, "REGULATION R-10 (Part 1)"), ("1", 2, 1, "REGULATION R-10 (Part 2)"),
    ]


def test_hybrid_uses_the_nearest_text_for_the_rest(spark, store):
    found = retrieve.hybrid(ask(spark, "O-2", "R-77", "cars limits on", None), store, 2)
    routes = {(r["question_id"], r["route"]) for r in found.collect()}
    assert routes == {("0", "exact"), ("1", "nearest"), ("2", "nearest"), ("3", "nearest")}
    first = found.filter("question_id = '2' AND rank = 1").first()
    assert first["section"] == "REGULATION R-1" and first["doc_id"] == 1


def test_title_match(spark, store):
    asked = ask(spark, " regulation r-1 ", "PART 2", "", "  ", "regulation r-2", "definitions & minimum requirements", "o-2")
    rows = {r["question_id"]: (r["doc_id"], r["section"]) for r in retrieve.title_match(asked, store).collect()}
    assert rows == {"0": (1, "REGULATION R-1"), "1": (1, "REGULATION R-10 (Part 2)"),
                    "5": (1, X.INTRO_SECTION), "6": (1, "REGULATION O-2")}


def test_answers_are_ordered_and_sources_unique(spark, store):
    row = retrieve.answers(retrieve.exact_lookup(ask(spark, "r10"), retrieve.regulation_parts(store))).first()
    assert row["sources"] == ["REGULATION R-10 (Part 1)", "REGULATION R-10 (Part 2)"]
    assert row["context"].startswith("[REGULATION R-10 (Part 1)]\nREGULATION R-10\nword")
    assert "\n\n[REGULATION R-10 (Part 2)]\n" in row["context"]


def test_overview_counts_the_store(spark, store):
    rows = answer_questions(ask(spark, "How many regulations are there?", "list all the Regulations"), store).collect()
    assert len(rows) == 2
    assert all("total of 3 specific" in r["answer"] and "- 2 'R'" in r["answer"] for r in rows)
    assert all(r["sources"] == [X.OVERVIEW_SOURCE] for r in rows)


def test_citations(spark):
    df = spark.createDataFrame([
        ("see Regulation r-1 and REGULATION O-2", ["REGULATION R-1", "regulation o-2 (Part 3)"]),
        ("see regulation R-1", ["REGULATION R-10"]), ("nothing cited", []), ("REGULATION  R-1", ["REGULATION R-1"]),
    ], "t string, s array<string>")
    got = [r["m"] for r in df.select(retrieve.unsupported_citations(F.col("t"), F.col("s")).alias("m")).collect()]
    assert got == [[], ["REGULATION R-1"], [], ["REGULATION  R-1"]]


def test_titles_of_ten_thousand_characters(spark):
    """Contained questions are found by their rarest piece, short ones too; the first chunk wins."""
    long = "".join(chr(97 + (i * 7 + i // 26) % 26) for i in range(10_000)) + " é😀 end"
    rows = [(2, 1, 0, long), (1, 1, 0, long), (3, 1, 0, "Regulation R-1 (Part 2)"), (4, 1, 0, "Regulation R-10"), (5, 1, 0, None)]
    chunks = spark.createDataFrame([(d, o, p, s, "text") for d, o, p, s in rows], "doc_id long, ord int, part int, section string, text string")
    asked = {"a": long[5000:5400], "b": "R-1", "c": " r-10 ", "d": "é😀", "e": "😀", "f": "zz not there", "g": "  ", "h": None, "i": long + "x", "j": "R-1 (p",
             "k": long[5000:5400]}
    questions = spark.createDataFrame(list(asked.items()), "question_id string, question string")
    got = {r["question_id"]: r["doc_id"] for r in retrieve.title_match(questions, chunks).collect()}
    want = {}
    for key, text in asked.items():
        piece = (text or "").strip().lower()
        held = [d for d, _, _, s in rows if s and piece and piece in s.lower()]
        if held:
            want[key] = min(held)
    assert got == want
