"""Near-duplicates, decontamination, privacy, mixing and neighbours against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from creditloom.llm import components, decontaminate, mixing, neighbours, privacy, simhash
from creditloom.llm.queries import WEIGHTS, mixture_levels


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(500, 600)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(601, pairs)
    assert got == {n: want[n] for n in {x for p in pairs if p[0] != p[1] for x in p}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_allocation_keeps_the_pigeonhole():
    costs = [[1.0, 30.0, 500.0, 1e4, 1e5], [2.0, 10.0, 90.0, 1e3, 1e4], [5.0, 6.0, 70.0, 1e3, 1e4]]
    chosen = simhash.allocate(costs, 4)
    assert sum(t + 1 for t in chosen) == 5
    import itertools
    every = [t for t in itertools.product(range(-1, 5), repeat=3) if sum(x + 1 for x in t) == 5]
    cost = lambda t: sum(c[x] for c, x in zip(costs, t) if x >= 0)
    assert cost(chosen) == min(map(cost, every))


def slow_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(5000, None), (5001, ""), (5002, "one"), (5002, "one"), (None, "one"), (5003, "A b\tC"), (5004, "a B c")],
                                  "doc_id long, text string")
    both = table.unionByName(extra).selectExpr("*", "1 AS print", "2 AS root", "3 AS least")
    got = simhash.near_duplicates(both).collect()
    rows = [(r.doc_id, r.text) for r in both.collect()]
    prints = [slow_print(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    group = roots(len(rows), pairs)
    least = defaultdict(list)
    for (key, _), g in zip(rows, group):
        least[g] += [key] if key is not None else []
    want = sorted((key if key is not None else -1, f"{p:016x}", min(least[g])) for (key, _), p, g in zip(rows, prints, group))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.keep_one(both)
    assert kept.columns == both.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({min(k) for k in least.values()})
    assert simhash.near_duplicates(both.filter("false")).count() == 0 and simhash.keep_one(both.filter("false")).count() == 0


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_contamination(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "ß1"]
    some = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(1, some(30)), (2, some(13)), (3, "Solo"), (4, some(5)), (5, None), (6, ""), (7, "..."), (None, some(20))]
    items.append((8, items[0][1]))
    texts = [None, "", "solo", some(400), some(12)]
    texts += [some(n) + " " + " ".join(words(t)[a:a + m]) + ", " + some(40) for _, t in items[:4] for n, a, m in ((3, 0, 13), (50, 2, 12), (7, 1, 29))]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[6])], "doc_id long, text string")
    docs = docs.selectExpr("*", "text AS words", "1 AS n_hit", "2 AS row")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    got = decontaminate.report(docs, bench).collect()
    spans = defaultdict(set)
    for key, text in items:
        ws = words(text)
        if key is not None and ws:
            n = min(13, len(ws))
            for at in range(len(ws) - n + 1):
                spans[tuple(ws[at:at + n])].add(key)
    want = []
    for r in docs.collect():
        ws, hit, found = words(r.text), set(), set()
        for n in {len(s) for s in spans}:
            for at in range(len(ws) - n + 1):
                if tuple(ws[at:at + n]) in spans:
                    hit |= set(range(at, at + n))
                    found |= spans[tuple(ws[at:at + n])]
        want.append((str(r.doc_id), len(ws), len(hit), len(found), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(ws)))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in got) == sorted(want)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)
    assert decontaminate.drop_contaminated(docs, bench.filter("false")).count() == docs.count()
    assert decontaminate.report(docs.filter("false"), bench).count() == 0


def test_winnowing_covers_every_window():
    hashes = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    places = set(decontaminate.winnow(hashes, 7).tolist())
    for at in range(len(hashes) - 6):
        inside = [p for p in range(at, at + 7) if p in places]
        assert inside and min(hashes[at:at + 7]) in hashes[inside]


PRIVATE = [
    (1, "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 256.1.1.1 +1 (338) 555-7198  +49 30 123 4111 1111 1111 1111 1234"),
    (2, "1" * 30000 + " " + "1." * 5000 + "a" * 20000 + "@" + "b." * 5000), (3, None), (4, ""),
    (5, "ÜÖ😀 x@y.zz 4111-1111-1111-1111"), (5, "ÜÖ😀 x@y.zz 4111-1111-1111-1111"), (None, "me@home.org"),
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def slow_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate((
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")),
                    "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_identifiers(spark):
    docs = spark.createDataFrame(PRIVATE, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS kind")
    got = privacy.report(docs).collect()
    assert sorted((str(r.doc_id), r.base) for r in got) == sorted((str(k), slow_spans(t)) for k, t in PRIVATE)
    assert privacy.report(docs.filter("false")).count() == 0
    clean = privacy.sanitise(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[3] is None and texts[4] == "" and texts[5] == "ÜÖ😀 [EMAIL] [CARD]" and texts[None] == "[EMAIL]"


def test_revealing_terms(spark):
    common = ["the house of many doors", "a river runs past it", "people talk and walk"]
    rows = [(i, f"{common[i % 3]} number {i}") for i in range(400)]
    rows += [(1000 + i, f"{common[i % 3]} {i} then Zorblatt wrote from zor@blatt.org {common[(i + 1) % 3]} {i}") for i in range(4)]
    rows += [(2000, "only zorblatt here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in privacy.report(docs, protected_share=0.05).collect()}
    for key, text in rows[400:]:
        at = text.lower().index("zorblatt")
        assert f"term:{at}:{at + 8}" in got[key].spans.split(",")
    assert all(got[i].spans == "" for i in range(400))
    assert "orblatt" not in privacy.sanitise(docs, protected_share=0.05, remove=0.5).filter("doc_id = 2000").first().text


def test_rare_and_frequent_identifiers_disclose(spark, small):
    common = ["the house of many doors", "a river runs past it", "people talk and walk"]
    rows = [(i, f"{common[i % 3]} number {i}") for i in range(200)]
    rows += [(1000, f"{common[0]} Quillfeather asked q@one.org {common[1]}")]
    rows += [(2000 + i, f"{common[i % 3]} Hotspurline hot@spur.com {common[i % 2]}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in privacy.report(docs).collect()}
    for key, text in rows[200:]:
        name = "Quillfeather" if key == 1000 else "Hotspurline"
        at = text.index(name)
        assert f"term:{at}:{at + len(name)}" in got[key].spans.split(",")
    assert all(got[i].spans == "" for i in range(200))
    assert privacy.report(spark.read.parquet(f"{small}/documents.parquet")).agg(F.sum("n_term")).first()[0] > 0


def slow_disclosures(texts, entities):
    held = [{t for t in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower())
             if 3 <= len(t) <= 64 and not t.isdigit()} for text in texts]
    with_term, both, with_entity = Counter(t for ts in held for t in ts), Counter(), Counter()
    for ts, es in zip(held, entities):
        with_entity.update(es)
        both.update((e, t) for e in es for t in ts)
    worst = defaultdict(float)
    for (e, t), n in both.items():
        p = with_entity[e] / len(texts)
        if p < 1:
            worst[t] = max(worst[t], 1 - np.log((n + 0.5 * p) / (with_term[t] + 0.5)) / np.log(p))
    return {t: d for t, d in worst.items() if d >= 0.9}


def test_terms_are_counted_in_whole_texts(spark):
    filler = " ".join(["the house of many doors"] * 30)
    texts = [f"{filler} number {i}" for i in range(300)]
    texts += [f"{n}rblatt, 42, paid {i} with 4111 1111 1111 1111 {filler} then \u0130zmir{n}. zo@b.org" for i, n in enumerate(["Zo", "zO", "ZO"])]
    texts += [f"zorblatt {filler} zorblatt"]
    entities = [()] * 300 + [("card", "email")] * 3 + [()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = privacy.identifiers(docs, row="doc_id", text="text")
    terms, where = privacy.revealing_terms(docs, base, row="doc_id", text="text")
    want = slow_disclosures(texts, entities)
    got = {r.term: r.disclosure for r in terms.collect()}
    assert got == pytest.approx(want) and {"zorblatt", "paid", "then", "i\u0307zmirzo"} <= set(got)
    found = {(r.row, r.term, texts[r.row][r.start:r.end]) for r in privacy.term_spans(docs, where, terms, row="doc_id", text="text").collect()}
    assert {(r, w) for r, t, w in found if t == "zorblatt"} == {(300, "Zorblatt"), (301, "zOrblatt"), (302, "ZOrblatt"), (303, "zorblatt")}
    assert {w for _, t, w in found if t == "i\u0307zmirzo"} == {"\u0130zmirZo", "\u0130zmirzO", "\u0130zmirZO"}
    assert all(w.lower() == t for _, t, w in found)


def test_mixing(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    odd = table.limit(3).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "n_chars")
    both = table.unionByName(odd).unionByName(table.limit(2)).unionByName(table.limit(1).withColumn("text", F.lit(None).cast("string")))
    both = both.selectExpr("*", "1 AS leaf", "2 AS copies", "3 AS granted")
    total = both.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    for budget in (0, 1, total // 3, total, 3 * total, 100 * total):
        rows = mixing.mixed(both, mixture_levels(), WEIGHTS, budget=budget).toPandas()
        assert len(rows) == both.count()
        leaves = rows.assign(got=rows.copies * rows.n_tokens).groupby(["domain", "lang", "source"], dropna=False).agg(
            got=("got", "sum"), granted=("granted", "first"), supply=("n_tokens", "sum"), longest=("n_tokens", "max"))
        assert leaves.granted.sum() == min(budget, 4 * leaves.supply.sum())
        assert (leaves.got >= leaves.granted).all() and (leaves.got < leaves.granted + 3 * leaves.longest + 1).all()
    taken = mixing.take_mixture(both, mixture_levels(), WEIGHTS)
    assert taken.columns == both.columns
    assert taken.count() == mixing.mixed(both, mixture_levels(), WEIGHTS).agg(F.sum("copies")).first()[0]
    assert mixing.take_mixture(both.filter("false"), mixture_levels(), WEIGHTS).count() == 0


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "top string, leaf string, supply long")
    got = {r.leaf: r.granted for r in mixing.leaf_budgets(leaves, ["top", "leaf"], {"a": 1, "b": 1}, 1000, epochs=1).collect()}
    assert got == {"x": 10, "y": 490, "z": 500}
    with pytest.raises(ValueError):
        mixing.leaf_budgets(leaves, ["top", "leaf"], {"a": -1}, 10)


def test_neighbours(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    width = len(table.first().embedding)
    unit = [1.0] + [0.0] * (width - 1)
    odd = [(None, unit), (9001, None), (9002, [0.0] * width), (9003, [float("nan")] + unit[1:]), (9004, [None] + unit[1:]), (9005, [1.0]),
           (9006, [float("inf")] + unit[1:]), *[(10000 + i, unit) for i in range(60)], (10000, unit), (20000, [3.0 * x for x in unit])]
    both = table.unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).selectExpr("*", "1 AS q", "2 AS score", "3 AS v")
    got = defaultdict(list)
    for r in neighbours.nearest(both, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    rows = sorted({(r.vec_id, tuple(r.embedding)) for r in both.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == width
                   and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)})
    ids, vectors = np.array([k for k, _ in rows]), np.array([v for _, v in rows], dtype=float)
    hits = total = 0
    assert set(got) == {int(k) for k in ids if k % 20 == 0}
    for i, key in enumerate(ids):
        if key % 20 == 0:
            scores = vectors @ vectors[i]
            order = [j for j in np.lexsort((ids, -np.round(scores, 9))) if ids[j] != key][:20]
            hits += len({k for k, _ in got[key]} & {int(ids[j]) for j in order})
            total += 20
            assert len(got[key]) == 20 and all(abs(s - scores[list(ids).index(k)]) < 1e-9 for k, s in got[key])
    assert hits >= 0.9 * total
    assert [k for k, _ in got[10000]][:3] == [20000, 10001, 10002]
    assert neighbours.nearest(both.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
