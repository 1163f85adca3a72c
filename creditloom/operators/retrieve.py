"""Questions to regulations: exact lookup first, nearest text second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed as X
from .. import schemas as S
from ..functions.text import strip
from ..session import materialize
from .nearest import Index, index_store, nearest
from .vectors import with_counts

QUESTION = "question_id"
ROUTE_EXACT, ROUTE_NEAREST, ROUTE_TITLE = "exact", "nearest", "title"
UNDECIDED = "undecided"
GRAM = 3  # characters of an entry in the index of titles


def requested_regulation(question: Column) -> dict[str, Column]:
    """`letter` and `number` of the first regulation a question names, else null."""
    upper = F.upper(question)
    letter = F.nullif(F.regexp_extract(upper, X.REQUESTED_PATTERN, 1), F.lit(""))
    number = F.regexp_extract(upper, X.REQUESTED_PATTERN, 2).try_cast("bigint")
    return {"letter": F.when(number.isNotNull(), letter), "number": number}


def section_regulation(section: Column) -> dict[str, Column]:
    """`letter` and `number` of a section title. Numbers are compared, so R-1 is not R-10."""
    upper = F.upper(strip(section))
    letter = F.nullif(F.regexp_extract(upper, X.SECTION_ID_PATTERN, 1), F.lit(""))
    return {"letter": letter, "number": F.regexp_extract(upper, X.SECTION_ID_PATTERN, 2).try_cast("bigint")}


def regulation_parts(chunks: DataFrame) -> DataFrame:
    """For every regulation the parts of its first section in store order.

    One section per regulation: the size of an answer does not grow with the
    number of documents that contain a heading.
    """
    named = chunks.select("doc_id", "ord", *[c.alias(n) for n, c in section_regulation(F.col("section")).items()])
    first = named.filter("number IS NOT NULL").groupBy("letter", "number").agg(F.min(F.struct("doc_id", "ord")).alias("first"))
    at = first.select("letter", "number", F.col("first.doc_id").alias("doc_id"), F.col("first.ord").alias("ord"))
    return chunks.select(*S.CHUNK_KEY, "section", "text").join(at, ["doc_id", "ord"])


def exact_lookup(questions: DataFrame, parts: DataFrame) -> DataFrame:
    """(question_id, rank, chunk) for questions that name a regulation; `parts` as by regulation_parts."""
    asked = questions.withColumns(requested_regulation(F.col("question"))).filter(F.col("number").isNotNull())
    return asked.select(QUESTION, "letter", "number").join(parts, ["letter", "number"]).select(
        QUESTION, F.greatest(F.col("part"), F.lit(1)).alias("rank"), *S.CHUNK_KEY, "section", "text",
        F.lit(0.0).alias("distance"), F.lit(ROUTE_EXACT).alias("route"),
    )


def attach_chunks(found: DataFrame, chunks: DataFrame, route: str = ROUTE_NEAREST) -> DataFrame:
    return found.join(chunks.select(*S.CHUNK_KEY, "section", "text"), S.CHUNK_KEY).select(
        QUESTION, "rank", *S.CHUNK_KEY, "section", "text", "distance", F.lit(route).alias("route"))


def chunk_index(store: DataFrame, k: int = X.TOP_K) -> Index:
    """The store's `counts`, ready for any number of searches."""
    return index_store(store, k, store_key=S.CHUNK_KEY)


def nearest_chunks(questions: DataFrame, store: DataFrame | Index, k: int = X.TOP_K) -> DataFrame:
    """(question_id, rank, chunk key, distance). The store brings its `counts`, or is given as an index."""
    asked = with_counts(questions.select(QUESTION, "question"), "question")
    index = store if isinstance(store, Index) else chunk_index(store, k)
    return nearest(asked, index, k, question_key=QUESTION)


def regulation_table(chunks: DataFrame) -> DataFrame:
    """regulation_parts, written once: one section per regulation."""
    return materialize(regulation_parts(chunks), "regulations")


def hybrid(
    questions: DataFrame, store: DataFrame, k: int = X.TOP_K, parts: DataFrame | None = None, index: Index | None = None,
) -> DataFrame:
    """Exact where a named regulation is in the store, nearest for all other questions.

    `parts` and `index` are the regulation table and the index of the store, for callers that come back.
    """
    parts = regulation_table(store) if parts is None else parts
    requested = questions.withColumns(requested_regulation(F.col("question")))
    others = requested.join(parts, ["letter", "number"], "left_anti")
    near = attach_chunks(nearest_chunks(others, store if index is None else index, k), store)
    return exact_lookup(questions, parts).unionByName(near)


def _grams(text: Column, size: int) -> Column:
    """The different pieces of `size` characters of a text."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
    return F.array_distinct(F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda at: F.substring(text, at, F.lit(size))))


def title_match(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """First chunk whose section contains the whole question, as rank 0 at distance 0.

    An inverted list leads from pieces of GRAM characters to the distinct titles
    that have them, one entry per piece and title. A question looks into the list
    of its rarest piece only, and what stands there is compared with the whole
    question; one shorter than GRAM is a piece itself. Equal questions are looked
    up once. Blank questions match nothing.
    """
    titles = materialize(chunks.groupBy(F.lower("section").alias("title")).agg(F.min(F.struct(*S.CHUNK_KEY)).alias("first")), "titles")
    every = F.flatten(F.array(*[_grams(F.col("title"), size) for size in range(1, GRAM + 1)]))
    lists = materialize(titles.select("title", "first", F.explode(every).alias("gram")), "title-grams")
    sizes = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = questions.select(QUESTION, F.lower(strip(F.col("question"))).alias("piece")).filter("piece <> ''")
    # What is longer than every title is in none.
    longest = titles.agg(F.max(F.length("title"))).scalar()
    pieces = asked.filter(F.length("piece") <= longest).select("piece").distinct()
    piece = F.col("piece")
    own = F.when(F.length(piece) <= GRAM, F.array(piece)).otherwise(_grams(piece, GRAM))
    met = pieces.select("piece", F.size(own).alias("grams"), F.explode(own).alias("gram")).join(sizes, "gram")
    # A piece that no title has is in no list: then the question is in no title.
    rarest = met.groupBy("piece", "grams").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("n", "gram")).alias("rare")).filter(
        F.col("known") == F.col("grams")).select("piece", F.col("rare.gram").alias("gram"))
    matched = rarest.join(lists, "gram").filter(F.contains("title", "piece")).groupBy("piece").agg(F.min("first").alias("first"))
    found = asked.join(matched, "piece").select(QUESTION, F.lit(0).alias("rank"), "first.*", F.lit(0.0).alias("distance"))
    return attach_chunks(found, chunks, ROUTE_TITLE)


def with_title_match(results: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Retrieval results with the title match, where there is one, in front."""
    return title_match(questions, chunks).unionByName(results)


def is_overview(question: Column) -> Column:
    return F.coalesce(question.rlike(X.OVERVIEW_PATTERN), F.lit(False))


def overview_answer(chunks: DataFrame) -> DataFrame:
    """One row: how many regulations of each kind the store holds."""
    named = chunks.select(F.struct(*[c.alias(n) for n, c in section_regulation(F.col("section")).items()]).alias("r"))
    distinct = named.filter("r.number IS NOT NULL").select("r.letter", "r.number").distinct()
    r, o = F.count_if(F.col("letter") == "R"), F.count_if(F.col("letter") == "O")
    return distinct.agg(F.format_string(X.OVERVIEW_ANSWER, r + o, r, o).alias("answer"))


def answer_overviews(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, answer, sources) for questions about the corpus as a whole."""
    asked = questions.filter(is_overview(F.col("question")))
    return asked.select(
        QUESTION, overview_answer(chunks).scalar().alias("answer"), F.array(F.lit(X.OVERVIEW_SOURCE)).alias("sources"))


def plain_number(value: Column) -> Column:
    """A double the way it is read aloud: never in exponent form, at least one decimal."""
    whole = F.concat(value.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    fraction = F.regexp_replace(value.cast("decimal(38,6)").cast("string"), "0+$", "")
    return F.when(value == F.floor(value), whole).otherwise(fraction)


def applicant_question(given: Column | None = None) -> Column:
    """Aggregate cap, then clean cap, then the given question, then the template."""
    template = F.format_string(
        X.QUESTION_TEMPLATE, F.coalesce(F.lower("risk_decision"), F.lit(UNDECIDED)),
        F.coalesce(plain_number(F.col("LIMIT_BAL")), F.lit("N/A")),
    )
    if given is not None:
        template = F.coalesce(F.nullif(given, F.lit("")), template)
    return (
        F.when(F.col(f"cap_flags.{X.FLAG_AGGREGATE}"), X.QUESTION_AGGREGATE)
        .when(F.col(f"cap_flags.{X.FLAG_CLEAN}"), X.QUESTION_CLEAN)
        .otherwise(template)
    )


def answers(results: DataFrame) -> DataFrame:
    """(question_id, context, sources): k chunks, or the parts of one regulation, per question."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", *S.CHUNK_KEY, "section", "text")))
    return (
        results.groupBy(QUESTION).agg(ordered.alias("chunks"))
        .select(
            QUESTION,
            F.array_join(F.transform("chunks", lambda c: F.concat(F.lit("["), c["section"], F.lit("]\n"), c["text"])),
                         "\n\n").alias("context"),
            F.array_distinct(F.transform("chunks", lambda c: c["section"])).alias("sources"),
        )
    )


def cited(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(X.HEADING_PATTERN), F.lit(0)))


def unsupported_citations(text: Column, sources: Column) -> Column:
    """Regulations a text cites that are not among its sources; part numbers do not matter."""
    known = F.transform(sources, lambda s: F.regexp_replace(F.upper(s), r" \(PART [0-9]+\)$", ""))
    return F.array_except(cited(text), known)
