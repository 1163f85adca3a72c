r"""Personal data, and the terms that give it away.

Identifiers of four kinds are found by pattern. The corpus then says which terms
reveal them: a term that is found in texts with one identifier, and hardly anywhere else,
tells who is meant even where the identifier itself has been taken out. With
D texts, the information of an identifier e is IC(e) = -log P(e), where P(e) =
texts with e / D; a term's mutual information with it is PMI(t, e) =
log(P(e | t) / P(e)), where P(e | t) = (texts with both + a P(e)) / (texts with
t + a), and its disclosure PMI / IC: near 1 if the term is seen only with the
identifier, 0 if they are independent. The prior a keeps one sighting from
counting as certain; no identifier is too rare or too frequent to be looked at.
Terms above one threshold are generalised, above a higher one removed, wherever
they occur.

Only DataFrame functions. A text is cut by its matches into pieces, whose lengths
give the positions. Repeated groups are possessive, which changes no match here
and keeps the matcher from recursing, so a run of any length is fine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .simhash import unused

LOCAL = "A-Za-z0-9._%+-"
#: Kind and pattern, in the order that breaks ties of place. A look-behind keeps a
#: run that has failed from being tried again at each of its characters.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
TERM = "term"
ALONE = "only:"  # stands for the identifiers that no other text has
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # terms are runs of anything else
SHORTEST, LONGEST = 3, 64  # characters of a term
PRIOR = 0.5  # texts with a term that are taken to hold an identifier as often as all texts do
GENERALISE, REMOVE = 0.9, 0.97
COMMON = 0.002  # share of the texts from which a term is common; there are at most 1 / COMMON times the terms of a mean text
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_lower(text: Column) -> Column:
    """A-Z lower-cased; keeps the length."""
    return F.translate(text, UPPER, LOWER)


# --- Identifiers -------------------------------------------------------------------------

def _possible(kind: str, text: Column) -> Column:
    """A cheap test that rules most texts out."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    return F.contains(text, F.lit("+")) if kind == "phone" else text.rlike("[0-9]")


def _holds(kind: Column, found: Column) -> Column:
    """The checks a match must pass; one that fails is dropped."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    card = n.between(12, 19) & F.call_function("luhn_check", digits)
    return (
        F.when(kind == "email", True).when(kind == "ip", found.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(kind == "card", card).otherwise(n.between(9, 15)))


def identifiers(docs: DataFrame, *, row: str, text: str) -> DataFrame:
    """(row, kind, rank, start, end, value), one row per identifier.

    Positions are in code points, the end exclusive. `row` is a unique long.
    """
    cut = docs.select(F.col(row).alias("row"), F.col(text).alias("text")).select(
        "row", *[
            F.when(_possible(kind, F.col("text")), part).alias(f"{kind}_{name}")
            for kind, pattern in PATTERNS.items()
            for name, part in (("pieces", F.split("text", pattern, -1)), ("found", F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))])
    whole = [
        F.when(F.size(f"{kind}_found") > 0, F.transform(
            F.arrays_zip(F.col(f"{kind}_pieces").alias("gap"), F.col(f"{kind}_found").alias("found")),
            _entry(rank))).otherwise(F.array().cast("array<struct<rank:int,place:int,gap:int,value:string>>"))
        for rank, kind in enumerate(KINDS)]
    rows = cut.select("row", F.explode(F.concat(*whole)).alias("m")).select("row", "m.*").filter(
        F.col("value").isNotNull())
    in_order = Window.partitionBy("row", "rank").orderBy("place")
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(upto)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1)
    placed = rows.withColumn("end", end).withColumn("kind", kind)
    return placed.filter(_holds(F.col("kind"), F.col("value"))).select(
        "row", "kind", "rank", (F.col("end") - F.length("value")).alias("start"), "end", "value")


def _entry(rank: int):
    return lambda zipped, place: F.struct(
        F.lit(rank).alias("rank"), place.alias("place"), F.length(zipped["gap"]).alias("gap"), zipped["found"].alias("value"))


# --- Disclosure ----------------------------------------------------------------------------

def terms_of(text: Column) -> Column:
    """The distinct terms of a text, lower-cased."""
    return F.array_distinct(F.split(F.lower(text), BETWEEN))


def revealing_terms(
    docs: DataFrame, found: DataFrame, *, row: str, text: str, protected_share: float = 1.0, generalise: float = GENERALISE,
) -> tuple[DataFrame, DataFrame]:
    """((term, disclosure), (row, term)): terms of at least `generalise`, and the rows that hold them.

    Every identifier has terms, in however few texts it is; a caller may declare
    those in more than `protected_share` of all texts public. One that is in all
    texts tells nothing.
    """
    texts = docs.agg(F.count(F.lit(1)).alias("texts"))
    value = F.when(F.col("kind") == "email", plain_lower(F.col("value"))).when(
        F.col("kind") == "ip", F.col("value")).otherwise(F.regexp_replace("value", "[^0-9]", ""))
    named = found.select("row", F.concat_ws(":", "kind", value).alias("entity")).distinct()
    known = named.groupBy("entity").agg(F.count(F.lit(1)).alias("e_texts")).withColumn(
        "p", F.col("e_texts") / texts.scalar()).filter((F.col("p") < 1) & (F.col("p") <= protected_share))
    # The largest t_texts with which a term can still reach `generalise`, if it is in all texts with the identifier.
    most = (F.col("e_texts") + PRIOR * F.col("p")) / F.pow("p", F.lit(1 - generalise)) - PRIOR + 1
    named = materialize(named.join(known.withColumn("most", most), "entity"), "entities")
    # Identifiers that are in one text only tell the same of its terms: one stands for all of them.
    own = F.when(F.col("e_texts") == 1, F.lit(ALONE)).otherwise(F.col("entity"))
    asked = named.select("row", own.alias("entity"), "e_texts", "p", "most").distinct()
    whole = F.length("term").between(SHORTEST, LONGEST) & ~F.col("term").rlike("^[0-9]*$")
    texts_of = docs.select(F.col(row).alias("row"), F.col(text).alias("text"))
    holds = texts_of.select("row", F.explode(terms_of(F.col("text"))).alias("term")).filter(whole)
    near = materialize(texts_of.join(named.groupBy("row").agg(F.max("most").alias("most")), "row").select(
        "row", "most", F.explode(terms_of(F.col("text"))).alias("term")).filter(whole), "near")
    spread = materialize(holds.groupBy("term").agg(F.count(F.lit(1)).alias("t_texts")), "spread")
    rare = materialize(spread.join(near.groupBy("term").agg(F.max("most").alias("most")), "term").filter(
        F.col("t_texts") <= F.col("most")).select("term", "t_texts"), "rare")
    seen = near.join(rare, "term").filter(F.col("t_texts") <= F.col("most")).select("row", "term", "t_texts")

    def disclosure(both: Column, t_texts: Column) -> Column:
        share = (both + PRIOR * F.col("p")) / (t_texts + PRIOR)  # P(e | t)
        return 1 - F.log(share) / F.log("p")

    # So do all terms that are in one text only: what they disclose at most is worked out once per text.
    single = asked.filter(F.col("most") >= 1).groupBy("row").agg(F.max(disclosure(F.lit(1), F.lit(1))).alias("disclosure"))
    alone = seen.filter(F.col("t_texts") == 1).join(single, "row").select("term", "disclosure")
    several = seen.filter(F.col("t_texts") > 1).join(asked, "row").filter(F.col("t_texts") <= F.col("most"))
    # The only text of an identifier is part of what it is.
    whose = F.when(F.col("e_texts") == 1, F.concat(F.lit(ALONE), F.col("row").cast("string"))).otherwise(F.col("entity"))
    pairs = several.groupBy(whose.alias("entity"), "term", "t_texts", "p").agg(F.count(F.lit(1)).alias("both"))
    told = pairs.select("term", disclosure(F.col("both"), F.col("t_texts")).alias("disclosure")).unionByName(alone)
    worst = materialize(told.groupBy("term").agg(F.max("disclosure").alias("disclosure")).filter(
        F.col("disclosure") >= generalise), "revealing")
    # Most words are common terms that reveal nothing: they are left out before the shuffle. Written, so that
    # Spark knows how large they are.
    common = materialize(spread.filter(F.col("t_texts") >= COMMON * texts.scalar()).join(worst, "term", "left_anti").select("term"), "common")
    return worst, holds.join(common, "term", "left_anti").join(worst.select("term"), "term", "left_semi")


def term_spans(docs: DataFrame, where: DataFrame, terms: DataFrame, *, row: str, text: str) -> DataFrame:
    """(row, start, end, term, disclosure): every occurrence of a revealing term as a whole word, in any case.

    Only rows that hold one are looked at, each cut into its words once. A row's
    terms travel with it and stand before its words, so words are not shuffled.
    """
    listed = where.groupBy("row").agg(F.collect_list("term").alias("terms"))
    texts = docs.select(F.col(row).alias("row"), F.col(text).alias("text")).join(listed.hint("merge"), "row")
    words = F.arrays_zip(
        F.split(F.lower("text"), BETWEEN, -1).alias("term"), F.split("text", BETWEEN, -1).alias("word"),
        F.regexp_extract_all("text", F.lit(BETWEEN), F.lit(0)).alias("after"))
    sizes = F.transform(words, lambda w, place: F.struct(
        place.alias("place"), w["term"].alias("term"), F.length(w["word"]).alias("size"),
        F.coalesce(F.length(w["after"]), F.lit(0)).alias("after")))
    asked = F.transform("terms", lambda t: F.struct(
        F.lit(-1).alias("place"), t.alias("term"), F.lit(0).alias("size"), F.lit(0).alias("after")))
    cut = texts.select("row", F.explode(F.concat(asked, sizes)).alias("w")).select("row", "w.*")
    before = Window.partitionBy("row").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("start", F.coalesce(F.sum(F.col("size") + F.col("after")).over(before), F.lit(0)))
    hit = placed.withColumn("first", F.min("place").over(Window.partitionBy("row", "term"))).filter("first < 0 AND place >= 0")
    return hit.join(terms, "term").select(
        "row", "start", (F.col("start") + F.col("size")).alias("end"), "term", "disclosure")


def find(docs: DataFrame, *, row: str, text: str, **options) -> DataFrame:
    """(row, kind, rank, start, end, disclosure): identifiers and revealing terms, one row per span.

    A term inside or across an identifier is left to it.
    """
    base = materialize(identifiers(docs, row=row, text=text), "identifiers")
    terms, where = revealing_terms(docs, base, row=row, text=text, **options)
    extra = materialize(term_spans(docs, where, terms, row=row, text=text), "term-spans")
    inside = base.select("row", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    meets = (extra["row"] == inside["row"]) & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    free = extra.join(inside, meets, "left_anti")
    return base.select("row", "kind", "rank", "start", "end", F.lit(1.0).alias("disclosure")).unionByName(free.select(
        "row", F.lit(TERM).alias("kind"), F.lit(len(KINDS)).alias("rank"), "start", "end", "disclosure"))


def _told_apart(docs: DataFrame, row: str) -> DataFrame:
    """Adds the long `row`, the same in every scan. Only a plan that reads files as they are gives each row its
    place again; any other is written first."""
    steps = re.findall(r"^[\s:+-]*(?:\*\(\d+\) )?(\w+)", docs._jdf.queryExecution().executedPlan().toString(), re.M)
    if not set(steps) <= {"FileScan", "Project", "Filter", "ColumnarToRow"}:
        docs = materialize(docs, "rows")
    return docs.withColumn(row, F.monotonically_increasing_id())


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, n_term, base, spans), one row per row of `docs`.

    `base` and `spans` list kind:start:end by start, then kind as in KINDS, terms
    last: identifiers alone, and with the revealing terms. Null and empty texts
    have none. Rows are told apart by their place in the scan, so repeated and
    null keys keep their own rows. Other columns are not looked at.
    """
    rows = _told_apart(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "row")
    spans = find(rows, row="row", text="text", **options)
    entry = F.struct("start", "rank", "end", "kind")

    def listed(which: Column) -> Column:
        return F.array_join(F.transform(
            F.array_sort(which), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}") for kind in [*KINDS, TERM]]
    grouped = spans.groupBy("row").agg(*counts, F.collect_list(entry).alias("all"))
    told = grouped.select("row", *[f"n_{k}" for k in [*KINDS, TERM]], listed(F.filter("all", lambda s: s["kind"] != TERM)).alias("base"),
                          listed(F.col("all")).alias("spans"))
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in [*KINDS, TERM]]
    return rows.select("row", "key").join(told, "row", "left").select(
        F.col("key").alias(key), *zero, F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))


def sanitise(docs: DataFrame, *, text: str = "text", remove: float = REMOVE, **options) -> DataFrame:
    """`docs` with the text rewritten, columns as they were; null stays null.

    Identifiers become `[EMAIL]`, `[IP]`, `[CARD]`, `[PHONE]`; terms become
    `[TERM]`, or nothing from disclosure `remove` on. Overlapping spans are one,
    with the tag of the first.
    """
    row, parts = unused(docs, "row"), unused(docs, "parts")
    marked = _told_apart(docs, row)
    spans = find(marked, row=row, text=text, **options)
    in_order = Window.partitionBy("row").orderBy("start", "rank", "end")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True))
    islands = spans.withColumn("opens", opens).withColumn("island", F.sum(F.col("opens").cast("int")).over(upto))
    tag = F.when((F.col("kind") == TERM) & (F.col("disclosure") >= remove), "").otherwise(
        F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
    merged = islands.groupBy("row", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(tag, F.struct("start", "rank")).alias("tag"))
    gaps = merged.withColumn("from", F.coalesce(F.lag("end").over(Window.partitionBy("row").orderBy("island")), F.lit(0)))
    listed = gaps.groupBy(F.col("row").alias(row)).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "from", "tag"))).alias(parts))
    told = marked.join(listed, row, "left")

    def piece(s: Column) -> Column:
        return F.concat(F.substring(F.col(text), s["from"].cast("int") + 1, (s["start"] - s["from"]).cast("int")), s["tag"])

    end = F.element_at(F.col(parts), -1)["end"].cast("int")
    rest = F.substring(F.col(text), end + 1, F.length(text))
    clean = F.when(F.col(parts).isNull(), F.col(text)).otherwise(F.concat(F.array_join(F.transform(parts, piece), ""), rest))
    return told.withColumn(text, clean).select(*docs.columns)


def digest(spans: Column) -> Column:
    return F.sha2(spans, 256)
