"""Token counts, token files, language, likelihood and chat against libraries, brute force and round trips."""

import math
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from creditloom.llm import chat, language, lattice, token_counts, token_files
from creditloom.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER, ENCODER = token_counts.MergeCounter(PATH), token_files.Encoder(PATH)
ODD = [None, "", "  a  b ", "a <|endoftext|> b<|endoftext|>", "x\n y", "é'll 日本語 ok", " lead", "trail ", "a\tb c  d",
       "don't we'll 12,5 a_b--c", "a" * 5000, "ab " * 3000, "\x1c x \x1c", "1.1.1." * 500]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def docs(spark, texts, more=""):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS row", "text AS words", "1 AS n_tokens")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_counts_and_ids_equal_the_library(text):
    assert COUNTER.counts([text]) == [len(ids(text))]
    assert next(iter(ENCODER.encode([text], 2))).tolist() == [*ids(text), 2]


def test_counts_of_odd_rows(spark):
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, ODD), PATH).collect()}
    for i, text in enumerate(ODD):
        assert got[i].n_tokens == len(ids(text)) and got[i].n_bytes == len((text or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 1024)
    assert token_counts.count_tokens(docs(spark, []), PATH).count() == 0


PLAIN = ["One, two; three 3.5 (four)", "Été\nnoël ïle.\nNext___ a1b2", "x " * 50 + "x", "%%% ***", ""]


@settings(max_examples=300, deadline=None)
@given(st.text("ab Z.,\n\ts'é×÷ÿß09日²_<|>", max_size=40), st.text("ab Z.,\né1", max_size=40))
def test_pieces_equal_the_library(mixed, plain):
    texts = [mixed, plain, *PLAIN, mixed + "<|endoftext|>" + plain, " " + plain, "\n" + mixed]
    assert COUNTER.counts(texts) == [len(ids(t)) for t in texts]
    assert [got.tolist() for got in ENCODER.encode(texts, 2)] == [[*ids(t), 2] for t in texts]


def test_plain_texts_are_not_searched_for_words_by_the_library():
    """That search is most of the library's time."""
    counter, encoder = token_counts.MergeCounter(PATH), token_files.Encoder(PATH)
    counter.split = encoder.library = None
    assert counter.counts(PLAIN) == [len(ids(t)) for t in PLAIN]
    encoder._library = lambda texts: [] if not texts else pytest.fail("a plain text went to the library as a whole")
    assert [got.tolist() for got in encoder.encode(PLAIN, 2)] == [[*ids(t), 2] for t in PLAIN]


def test_stale_entries_of_the_heap():
    """Neighbours merge away from each other in every order."""
    for text in ("aaaaaaaa", "abababab", "aaaabaaaab", "banananana" * 40, "mississippi" * 30):
        assert COUNTER.merge(text) == len(ids(text))


@pytest.mark.parametrize("width", [1, 7, 13, 16, 17, 32])
def test_packing_round_trip(width):
    values = np.random.default_rng(width).integers(0, 2**width, 1001, dtype=np.uint64).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(values, width), len(values), width) == values).all()


@pytest.mark.parametrize("block", [3, 8, 4096])
def test_segment_random_access(block):
    rng = np.random.default_rng(block)
    parts = [rng.integers(0, 5000, n, dtype=np.uint32) for n in (0, 1, 17, 300)]
    data = token_files.write_segment([None, -4, 0, 9], parts, 13, block)
    read = next(token_files.segments(data + b"\n"))
    assert read.keys == [None, -4, 0, 9]
    assert all((read.document(i) == part).all() for i, part in enumerate(parts))
    flat = np.concatenate(parts)
    assert (read.ids(5, 111) == flat[5:111]).all()


def test_token_files(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "none"), (3, "other")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS key", "1 AS segment")
    folder = scratch_path(spark, "test-tokens")
    token_files.write_token_files(table, folder, PATH, 2, 50257)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([k for k, _ in rows], key=lambda k: (k is not None, k or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = Counter((k, zlib.crc32(np.array([*ids(t), 2], "<u4").tobytes())) for k, t in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want


def test_token_files_of_nothing(spark):
    folder = scratch_path(spark, "test-none")
    token_files.write_token_files(docs(spark, []), folder, PATH, 2, 50257)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_language(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    found = language.identify(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 .. 34", "x"), (None, "the and of", None)],
                                "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in language.identify(table.select("doc_id", "text", "lang").unionByName(
        odd.withColumn("doc_id", odd.doc_id + 10**6))).filter("doc_id >= 1000000 OR doc_id IS NULL").collect()}
    assert [rows[10**6 + i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[None].lang_pred == "en"
    assert language.identify(odd.filter("false")).count() == 0
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", odd.lang.substr(9, 1)).filter("lang IS NULL")).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_letters():
    grams = language.Grams(width=64)
    got, letters = grams.bundles(["Ab, c"])
    want = np.zeros(64)
    for a, b, c in zip(" ab c ", "ab c ", "b c "):
        want += np.roll(grams.letter(ord(a)), 2).astype(int) * np.roll(grams.letter(ord(b)), 1) * grams.letter(ord(c))
    assert (got[0] == want).all() and letters[0] == 3


def test_word_likelihood_sums_all_segmentations():
    pieces = lattice.Pieces({b"a": math.log(0.1), b"ab": math.log(0.2)}, {b"a": math.log(0.05), b"b": math.log(0.3), b"bc": math.log(0.01),
                            b"c": math.log(0.04)}, math.log(0.15), math.log(0.1))

    def total(data):
        inside = {b"": 1.0}

        def rest(tail):
            if tail not in inside:
                inside[tail] = sum(math.exp(p) * rest(tail[len(k):]) for k, p in pieces.inner.items() if tail.startswith(k))
            return inside[tail]

        return math.exp(pieces.bare) * rest(data) + sum(
            math.exp(p) * rest(data[len(k):]) for k, p in pieces.initial.items() if data.startswith(k))

    for data in (b"a", b"ab", b"abc", b"abcab"):
        assert math.isclose(math.exp(lattice.Lattice(pieces).word(data)), total(data))


def test_likelihood(spark):
    texts = [None, "", "A b a", "b zz", "x" * 3000, "A b a", "sür le 日本"] * 3
    table = docs(spark, texts)
    got = {r.doc_id: r for r in lattice.likelihood(table, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    words = {i: (t or "").lower().split() + ["<end>"] for i, t in enumerate(texts)}
    seen = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n = sum(seen.values())
    for i, ws in words.items():
        base = sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (len(seen) + 1))) for w in ws)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(seen[w] > 0 for w in ws), n)
        assert math.isclose(got[i].base_score, base) and got[i].score < 0
    assert lattice.likelihood(table.filter("false"), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be\\l kind"), *[(1, n, "user" if n % 2 else "assistant", f"turn {n} <s>[INST] \\b " + "w " * n) for n in range(1, 30)],
            (2, 0, None, "a<|norole|>"), (2, 1, "to|ol\\p<", "x\\\\b["), (2, 1, "to|ol\\p<", "x\\\\b["), (None, None, "assistant", None),
            (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (3, 0, "assistant", "long " * 500)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS window", "2 AS k")
    made = chat.windows(table, lambda: lambda texts: [len(t.split()) for t in texts], 60, 20)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for key in (1, 2, None, -1, 3):
        turns = [(r or "", t or "") for k, _, r, t in rows if k == key]
        target = "".join(t for r, t in turns if r == "assistant")
        assert got[key].n_turns == len(turns)
        assert got[key].turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(target), sha256(target.encode()).hexdigest())
    windows = made.filter("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 3 and all(w.formatted.startswith("<<SYS>>") for w in windows)
    assert all(w.tokens <= 60 or w.over_budget for w in windows) and any(w.new_from > 20 for w in windows[1:])
    assert made.filter("conv_id = 3").first().over_budget
    assert chat.read_back(chat.windows(table.filter("false"), lambda: lambda t: [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", None, "tool|>", "role:a\\"]), st.text(max_size=30))))
def test_turns_are_read_as_written(turns):
    written = "".join(chat.render(role, text)[0] for role, text in turns)
    assert [(role, text) for role, text, _, _ in chat.parse(written)] == turns
