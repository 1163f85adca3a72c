"""Spelling variants and phrases against brute force, with odd rows, and in small parts."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from creditloom.llm import phrases, scan, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def long_text(n=200_000):
    rng = random.Random(4)
    return " ".join("".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(1, 12))) for _ in range(n // 6)) + "x" * 5000


def slow_counts(rows, lose, shortest):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if lose and h % lose == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= shortest:
                counts[run] += 1
    return counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def slow_variants(counts, ratio):
    forms = {}
    for word, n in counts.items():
        near = [w for w in counts if one_edit(word, w)]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        forms[word] = (best if best and counts[best] >= ratio * n else None, len(near))
    out = []
    for word, (form, near) in forms.items():
        root = word
        while forms[root][0]:
            root = forms[root][0]
        out.append((word, form, root, counts[word], near, counts[form] if form else None))
    return sorted(out, key=str)


def test_runs_end_with_their_text():
    texts = scan.Texts(pa.array(["aB", None, "", "c d", "é"])[0:5])
    inside = scan.byte_set("abcd")[texts.data]
    starts, ends = texts.runs(inside)
    assert texts.words(starts, ends, inside).to_pylist() == [b"ab", b"c", b"d"]
    assert texts.rows(starts).tolist() == [0, 3, 3]
    assert scan.Texts(pa.array(["x", "yy", "z"])[1:2]).data.tobytes() == b"yy"


@pytest.mark.parametrize("lose", [None, 3])
def test_word_counts(spark, lose):
    rows = [(1, "Straße ÀÉÎÕÜŸ×÷abcdefg naïveté"), (1, "Straße ÀÉÎÕÜŸ×÷abcdefg naïveté"), (2, None), (3, ""), (None, "ABCDEFGH ijklmnop"),
            (4, "日本語 abcdefĀghijkl x1abcdefgh-abcdefgh"), (5, long_text()), (6, "abc"), (7, "deflated́x")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "text AS key")
    got = {r.word: r.n for r in variants.word_counts(table, lose, 3).collect()}
    assert got == slow_counts(rows, lose, 3)
    assert variants.spelling_variants(table.limit(0), lose).collect() == []


def test_pairs_one_edit_apart():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(700)} | {"日本語", "日本誤", "日語"})
    by_length = {n: [w for w in words if len(w) == n] for n in range(1, 7)}
    for n, left in by_length.items():
        for right in (left, by_length.get(n + 1)):
            if right:
                rows, cols = variants.near_pairs(left, right)
                got = sorted(zip(rows.tolist(), cols.tolist()))
                assert got == [(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if one_edit(a, b)]


def test_group_variants(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK_WORDS", 50)
    monkeypatch.setattr(variants, "TILE_ROWS", 7)
    rng = random.Random(6)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))): rng.choice([1, 1, 2, 9, 60, 400]) for _ in range(400)}
    counts |= {"z" * 3000: 7, "z" * 2999: 70, "z" * 2998: 700, "q" * 40: 1}  # a chain, and a word near none
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    extra = spark.createDataFrame([(None, 3), ("", 4)], "word string, n long")
    got = sorted((tuple(r) for r in variants.group_variants(table.unionByName(extra), 5).collect()), key=str)
    assert got == slow_variants(counts, 5)


def test_spelling_variants_of_documents(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in variants.spelling_variants(table, lose=19, least=4).collect()), key=str)
    counts = slow_counts([(r.doc_id, r.text) for r in table.collect()], 19, 6)
    assert got == slow_variants({w: n for w, n in counts.items() if n >= 4}, 5)


# --- Phrases ------------------------------------------------------------------------------


def slow_collocations(rows, least, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i:i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    frequent = {p: a for p, a in counts.items() if a >= least}
    covers = Counter()
    for (lang, *words), a in frequent.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                part = (lang, *words[i:i + n])
                covers[part] = max(covers[part], a)
    out = []
    for phrase, a in frequent.items():
        lang, *words = phrase
        if len(words) < 2 or 100 * covers[phrase] >= 80 * a:
            continue
        cuts = [(counts[(lang, *words[:k])], counts[(lang, *words[k:])]) for k in range(1, len(words))]
        score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
        out.append((lang, " ".join(words), a, left, right, totals[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], at, *r[1:]) for at, r in enumerate(mine, 1)]
    return sorted(ranked)


def test_distinct_rows():
    rng = np.random.default_rng(1)
    for top in (3, 1 << 30):
        rows = rng.integers(0, top, (500, 4)).astype(np.int64)
        got, times = phrases._distinct_rows(np.r_[rows, rows[:100]])
        want = Counter(map(tuple, np.r_[rows, rows[:100]].tolist()))
        assert [(tuple(r), n) for r, n in zip(got.tolist(), times.tolist())] == sorted(want.items())


ODD = [("en", None), (None, "a B c a b c"), (None, "a b c"), ("en", ""), ("en", "A, b. c"), ("en", "  a b \x00 a\tb\x0bc É é"),
       ("fr", "le chat. le chat! le chat"), ("fr", "le chat"), ("de", "x " * 40), ("und", "a b c")]


@pytest.mark.parametrize("frequent", [phrases.FREQUENT, (3, 1 << 60), (40, 1 << 60)])
def test_collocations(spark, small, monkeypatch, frequent):
    """Also with words taken for frequent, whose suffixes go by more than one word."""
    monkeypatch.setattr(phrases, "FREQUENT", frequent)
    monkeypatch.setattr(phrases, "ROUTE_BYTES", 20_000)
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 5_000)
    table = spark.read.parquet(f"{small}/documents.parquet").select("lang", "text")
    table = table.unionByName(spark.createDataFrame(ODD + [("en", long_text(60_000))] * 2, "lang string, text string"))
    rows = [tuple(r) for r in table.collect()]
    odd = table.selectExpr("*", "1 AS phrase", "2 AS n", "3 AS a", "4 AS word", "5 AS rank")
    got = sorted(tuple(r) for r in phrases.collocations(odd, least=3, top=150).collect())
    assert got == slow_collocations(rows, 3, 150)


def test_collocations_of_no_rows(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), ("en", " .")], "lang string, text string"), least=1).collect() == []
