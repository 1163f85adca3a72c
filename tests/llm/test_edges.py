"""Long texts, odd rows, shuffled inputs and definitions spelt out, for operators that other files test on plain rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from creditloom.llm import chat, decontaminate, language, mixing, neighbours, privacy, simhash
from creditloom.llm.queries import WEIGHTS, mixture_levels

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def long_text(n=300_000, letters="abcdefghijklmnop", seed=3):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n // 6))


# --- Language ---------------------------------------------------------------------------------

def slow_bundle(grams, text):
    """Every n-gram's letters bound and added up, one by one."""
    kept = "".join(c if grams.in_word[ord(c)] else " " for c in f" {text.lower()} ")
    kept = " ".join(kept.split(" "))
    while "  " in kept:
        kept = kept.replace("  ", " ")
    out = np.zeros(grams.width)
    for gram, n in Counter(kept[i:i + 3] for i in range(len(kept) - 2)).items():
        out += n * np.prod([np.roll(grams.letter(ord(c)).astype(int), 2 - at) for at, c in enumerate(gram)], axis=0)
    return out


TEXTS = ["Ab, c", "", "été über 日本語!!", "a", "é ́̂", "x" * 50, "İstanbul ΣΑΣ. ΣΑ", "the cat and the hat " * 5, "12 34"]


@pytest.mark.parametrize("block, held", [(4096, 4096), (3, 2)])
def test_bundles_are_sums_of_bound_letters(monkeypatch, block, held):
    monkeypatch.setattr(language, "BLOCK", block)
    monkeypatch.setattr(language, "LETTERS_HELD", held)
    grams = language.Grams(width=64)
    got, letters = grams.bundles(TEXTS)
    assert np.array_equal(got, [slow_bundle(grams, t) for t in TEXTS])
    assert letters.tolist() == [sum(grams.is_letter[ord(c)] for c in t.lower()) for t in TEXTS]


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_a_long_text_is_bundled_piece_by_piece(monkeypatch, size):
    monkeypatch.setattr(language, "BATCH_CHARS", size)
    grams = language.Grams(width=64)
    for text in [t * 3 for t in TEXTS] + ["ab  cd " * 9, " " * 20, "a" + " " * 20 + "b"]:
        got, letters = grams.long_bundle(text)
        assert np.array_equal(got, slow_bundle(grams, text)) and letters == sum(grams.is_letter[ord(c)] for c in text.lower())


def test_the_language_of_the_largest_cosine_wins(spark):
    rng = random.Random(2)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(5)) for _ in range(40)]
                  for lang, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "ijklmnop"))}
    rows = [(i, " ".join(rng.choices(vocabulary[lang], k=rng.choice([1, 3, 30]))), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(500, "́̂", None), (501, None, "aa"), (502, "日本", None), (3, rows[3][1], rows[3][2]), (None, "abcd", None)]
    rows += [(600 + i, "zzqq zzqq", lang) for i, lang in enumerate(("dd", "ee", "dd", "ee"))]  # two languages of one text: a tie
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS key", "2 AS lang_pred", "3 AS found")
    got = Counter((r.doc_id, r.held_out, r.lang_pred) for r in language.identify(docs).collect())
    held = [k is not None and zlib.crc32(str(k).encode()) % 3 == 1 for k, _, _ in rows]
    grams = language.Grams()
    sums = {}
    for (_, text, lang), out in zip(rows, held):
        if not out and text is not None and lang is not None:
            sums[lang] = sums.get(lang, 0) + slow_bundle(grams, text)
    names = sorted(sums)
    want = Counter()
    for (key, text, _), out in zip(rows, held):
        letters = sum(grams.is_letter[ord(c)] for c in (text or "").lower())
        vector = slow_bundle(grams, text or "")
        cosines = [vector @ sums[n] / np.linalg.norm(sums[n]) for n in names]
        want[key, out, names[int(np.argmax(np.round(cosines, 12)))] if letters else "und"] += 1
    assert got == want
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k, t, _ in rows if k not in (500, 501))


def test_a_very_long_text_of_many_letters(spark, monkeypatch):
    monkeypatch.setattr(language, "BATCH_CHARS", 20_000)
    rng = random.Random(1)
    text = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(70_000))
    docs = spark.createDataFrame([(1, text, "zh"), (2, text[:5000], None), (3, "the cat", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}[2] in ("zh", "en")


# --- Privacy ----------------------------------------------------------------------------------

def test_spans_stay_with_their_documents_behind_a_shuffle(spark, small):
    """Adaptive partitions differ between scans that read different columns."""
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: r.spans for r in privacy.report(table).collect()}
    clean = {r.doc_id: r.text for r in privacy.sanitise(table).collect()}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "40k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        shuffled = table.groupBy("doc_id").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("row"))
        assert {r.doc_id: r.spans for r in privacy.report(shuffled).collect()} == want
        assert {r.doc_id: r.text for r in privacy.sanitise(shuffled).collect()} == clean
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    assert sum(bool(s) for s in want.values()) > 5


def test_a_text_of_ten_thousand_identifiers_and_terms(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfgh") + rng.choice("aeiou") for _ in range(4)) + str(i) for i in range(10_000)]
    big = " ".join(f"u{i}@h{i}.org {w}x" for i, w in enumerate(words))
    rows = [(i, f"the plain text number {i} of many") for i in range(60)] + [(100, big), (101, "u5@h5.org is here again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in privacy.report(docs).collect()}
    assert got[100].n_email == 10_000 and got[100].n_term > 0 and got[101].n_email == 1 and got[0].spans == ""


# --- Chat -------------------------------------------------------------------------------------

def slow_windows(turns, budget, history):
    """Turns (role, text, tokens) as lists of (turn, repeated)."""
    out, new, repeated, system, used = [], [], [], None, 0
    for turn in turns:
        if new and used + turn[2] > budget:
            out.append([(t, True) for t in repeated] + [(t, False) for t in new])
            head = [system] if system else []
            room = min(history, budget - turn[2] - sum(t[2] for t in head))
            tail = []
            for t in [t for t in repeated + new if t is not system][::-1]:
                if t[2] > room:
                    break
                tail.insert(0, t)
                room -= t[2]
            repeated, new = head + tail, []
            used = sum(t[2] for t in repeated)
        if turn[0] == "system" and system is None:
            system = turn
        new.append(turn)
        used += turn[2]
    return out + [[(t, True) for t in repeated] + [(t, False) for t in new]] if new else out


@pytest.mark.parametrize("seed", range(4))
def test_windows_against_their_definition(spark, seed):
    rng = random.Random(seed)
    rows = []
    for key in range(12):
        roles = [rng.choice(["user", "assistant", "tool"]) for _ in range(rng.randint(1, 40))]
        if key % 3:
            roles[rng.randrange(min(3, len(roles)))] = "system"
        rows += [(key, n // 2 if key % 4 == 0 else n, r, f"{r} {n} " + "w " * rng.randint(0, 25)) for n, r in enumerate(roles)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(table, lambda: lambda texts: [len(t.split()) for t in texts], 60, 25)
    got = {(r.conv_id, r.window): ([(role, text) for role, text, _, _ in chat.parse(r.formatted)], r.new_from, r.tokens) for r in made.collect()}
    for key in range(12):
        turns = [(r, t, len(t.split()) + chat.TURN_TOKENS) for _, _, r, t in sorted(x for x in rows if x[0] == key)]
        want = slow_windows(turns, 60, 25)
        assert sum(k == key for k, _ in got) == len(want)
        for at, window in enumerate(want):
            parsed, new_from, tokens = got[key, at]
            assert parsed == [t[:2] for t, _ in window] and tokens == sum(t[2] for t, _ in window)
            assert new_from == sum(len(chat.render(*t[:2])[0]) for t, repeated in window if repeated)


def test_a_system_turn_that_comes_late_is_kept(spark):
    rows = [(1, 0, "assistant", "hello"), (1, 0, "system", "be kind")] + [(1, n, "user", "w " * 20) for n in range(1, 9)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(table, lambda: lambda texts: [len(t.split()) for t in texts], 60, 20).orderBy("window").collect()
    assert len(made) > 2 and all("<<SYS>>be kind<</SYS>>" in w.formatted for w in made)


# --- Neighbours -------------------------------------------------------------------------------

def test_small_lists_are_left_for_the_next_ones(spark):
    """The nearest list holds fewer vectors than are asked for: the query looks on."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in (rng.normal(size=6) + 40 * np.eye(6)[i % 6])]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(table, F.col("vec_id") % 20 == 0, 30, probes=1).groupBy("query_id").count().collect()
    assert len(found) == 3 and all(r["count"] == 30 for r in found)


# --- Long texts -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def long_docs(spark):
    text = long_text()
    rows = [(1, text, "en", "src0", 1), (2, text, "en", "src0", 1), (3, text + " end", None, None, None), (4, "x" * 400_000, "en", "src1", 1), (5, "short", "en", "src2", 1)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "2 AS words", "3 AS leaf", "4 AS print", "5 AS k")


def test_long_texts_in_sets(spark, long_docs):
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(long_docs).collect()}
    assert groups[1] == groups[2] == groups[3] == 1 and groups[4] != 1
    bench = spark.createDataFrame([(7, long_text()[1000:1400]), (8, "nothing of this is in there at all")], "item_id long, text string")
    told = {r.doc_id: r for r in decontaminate.report(long_docs, bench).collect()}
    assert told[1].n_hit >= 13 and told[1]["items"] == ["7"] and not told[1].contaminated and told[5].n_hit == 0
    mixed = mixing.mixed(long_docs, mixture_levels(), WEIGHTS)
    assert mixed.count() == 5


def test_long_turns(spark):
    text = long_text(100_000) + "<s>["
    table = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.windows(table, lambda: lambda texts: [len(t.split()) for t in texts])).first()
    assert read.n_turns == 2 and read.loss_chars == len(text)


def test_stages_on_odd_rows(spark, small):
    """Nulls, empty and long texts, repeated rows, another column, no rows: through all stages but the last."""
    table = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    rows = [(None, None, None, None, None), (9001, "", "en", "src0", 0), (9002, long_text(), "en", "src0", 1), (9003, "A.", None, None, None),
            (9003, "A.", None, None, None), (None, "the cat sat", "en", None, 3)]
    odd = table.unionByName(spark.createDataFrame(rows, table.schema)).withColumn("row", F.lit(1)).withColumn("found", F.lit("x"))
    for docs in (odd, odd.filter("false")):
        some = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, small)
            assert kept.columns == odd.columns, name
            docs = spark.createDataFrame(kept.collect(), odd.schema)
        assert (docs.count() > 0) == (some > 0)
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd, small).count() == odd.count() and last(spark, odd.filter("false"), small).count() == 0
