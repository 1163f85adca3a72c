"""The SQL counterpart of every registered query that SQL can express.

The texts are DuckDB SQL on the same parquet tables, put together from the
common table expressions below.
"""

from __future__ import annotations

from creditloom import fixed as X

ORACLE: dict[str, str] = {}


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _nl(text: str) -> str:
    """A literal whose line breaks are spelled chr(10)."""
    return " || chr(10) || ".join(_q(part) for part in text.split("\n"))


def _cols(names, prefix: str = "") -> str:
    return ", ".join(prefix + n for n in names)


_WS = X.WHITESPACE
_STRIP = f"'^{_WS}+|{_WS}+$', '', 'g'"


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, {_STRIP})"


def _floor6(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5e0) / 1e6"


# --- Common table expressions ---------------------------------------------------------

_month = []
for m, (status, bill, paid) in enumerate(zip(X.STATUS_COLUMNS, X.BILL_COLUMNS, X.PAID_COLUMNS), 1):
    _month.append((status, f"CAST(max(CASE WHEN m = {m} THEN pay END) AS INT) AS {status}"))
    _month.append((bill, f"CAST(max(CASE WHEN m = {m} THEN bill END) AS DOUBLE) AS {bill}"))
    _month.append((paid, f"CAST(max(CASE WHEN m = {m} THEN paid END) AS DOUBLE) AS {paid}"))
_by_name = dict(_month)
_history = ",\n  ".join(_by_name[c] for c in X.STATUS_COLUMNS + X.BILL_COLUMNS + X.PAID_COLUMNS)

APPLICANTS = f"""
stmt AS (
  SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(14,2)) AS bill,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS m
  FROM orders),
line AS (
  SELECT o.o_orderkey, max(date_diff('day', o_orderdate, l_shipdate)) AS lag_days,
         sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(14,2))
                  ELSE CAST(0 AS DECIMAL(14,2)) END) AS paid
  FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey),
hist AS (
  SELECT s.o_custkey, s.m, s.bill, coalesce(l.paid, CAST(0 AS DECIMAL(14,2))) AS paid,
         CASE WHEN l.lag_days IS NULL THEN -2
              ELSE least(8, greatest(-1, CAST(floor(l.lag_days / 30.0) AS INT) - 2)) END AS pay
  FROM stmt s LEFT JOIN line l ON s.o_orderkey = l.o_orderkey WHERE s.m <= 6),
applicants AS MATERIALIZED (
  SELECT c_custkey AS applicant_id,
  CAST(CAST(c_acctbal AS DECIMAL(14,2)) * 600 AS DOUBLE) AS LIMIT_BAL,
  CAST(1 + c_custkey % 2 AS INT) AS SEX,
  CAST(c_nationkey % 7 AS INT) AS EDUCATION,
  CAST(c_custkey % 4 AS INT) AS MARRIAGE,
  CAST(15 + c_custkey % 90 AS INT) AS AGE,
  {_history},
  CAST(max(CASE WHEN (m = 0 AND pay >= 1) OR c_acctbal < 0 THEN 1 ELSE 0 END) AS INT) AS target
  FROM customer JOIN hist ON c_custkey = o_custkey
  GROUP BY c_custkey, c_acctbal, c_nationkey HAVING count(*) = 7)"""

_bills, _paid = " + ".join(X.BILL_COLUMNS), " + ".join(X.PAID_COLUMNS)
_status = " + ".join(X.STATUS_COLUMNS)
_late = " + ".join(f"(CASE WHEN {c} > 0 THEN 1 ELSE 0 END)" for c in X.STATUS_COLUMNS)
D = {
    "utilization_ratio": f"CASE WHEN coalesce(LIMIT_BAL, 0) <> 0 THEN round((({_bills}) / 6) / LIMIT_BAL, 4) ELSE 0e0 END",
    "avg_pay_delay": f"round(({_status}) / 6, 3)",
    "max_pay_delay": f"greatest({_cols(X.STATUS_COLUMNS)})",
    "months_late": f"CAST({_late} AS INT)",
    "payment_ratio": f"CASE WHEN ({_bills}) > 0 THEN round(({_paid}) / ({_bills}), 4) ELSE 1e0 END",
    "delay_trend": "PAY_0 - PAY_6",
}
EDUCATION = "CASE WHEN EDUCATION IN (0, 5, 6) THEN 4 ELSE EDUCATION END"
MARRIAGE = "CASE WHEN MARRIAGE = 0 THEN 3 ELSE MARRIAGE END"
RECODED = f"""
recoded AS (SELECT * REPLACE ({EDUCATION} AS EDUCATION, {MARRIAGE} AS MARRIAGE) FROM applicants)"""
FEATURES = f"""{APPLICANTS}, {RECODED},
features AS (SELECT applicant_id, {_cols(X.BASE_COLUMNS)},
  {", ".join(f"{expr} AS {name}" for name, expr in D.items())}, target FROM recoded)"""
PROBABILITY = (
    "round(1e0 / (1e0 + exp(-(0.5e0 * avg_pay_delay + 0.2e0 * months_late + -1e0 * payment_ratio"
    " + -0.05e0 * utilization_ratio + -3.2e0))), 6)"
)
SCORED = f"""{FEATURES},
probable AS (SELECT *, {PROBABILITY} AS risk_probability FROM features),
scored AS MATERIALIZED (SELECT *, CASE WHEN risk_probability >= 0.55e0 THEN 'REJECT' ELSE 'APPROVE' END AS risk_decision
  FROM probable)"""

_weights = {"avg_pay_delay": "0.5e0", "months_late": "0.2e0", "payment_ratio": "-1e0", "utilization_ratio": "-0.05e0"}


def _mean(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(24,6))) AS DOUBLE) / count({expr})"


_means = ", ".join(f"{_mean(c)} AS mean_{c}" for c in _weights)
_entries = ", ".join(
    "{{'pos': {at}, 'feature': '{c}', 'impact': {impact}, 'value': CAST({c} AS DOUBLE)}}".format(
        at=at, c=c, impact=f"round({_weights[c]} * ({c} - mean_{c}), 6)" if c in _weights else "0e0")
    for at, c in enumerate(X.FEATURE_COLUMNS)
)
CONTRIBUTIONS = f"""{SCORED},
means AS (SELECT {_means} FROM scored),
packed AS (SELECT applicant_id, unnest([{_entries}]) AS e FROM scored, means),
contributions AS MATERIALIZED (SELECT applicant_id, e.pos AS pos, e.feature AS feature, e.impact AS impact, e.value AS value
  FROM packed),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY applicant_id ORDER BY abs(impact) DESC, pos) AS rank
  FROM contributions)"""

_marker = _nl(X.FRONT_MATTER_END)
CORPUS = f"""
headed AS (
  SELECT doc_id, lang, source,
    substring(text, 1, 150) || chr(10) || 'REGULATION R-' || (1 + doc_id % 21) || chr(10) || substring(text, 151, 2500)
    || chr(10) || 'REGULATION O-' || (1 + doc_id % 8) || chr(10) || substring(text, 2651) AS text
  FROM documents),
fronted AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN 'Preface of ' || source || {_marker} || text ELSE text END AS text FROM headed),
corpus AS (
  SELECT doc_id, CASE WHEN strpos(text, {_marker}) > 0
    THEN substring(text, strpos(text, {_marker}) + {len(X.FRONT_MATTER_END)}) ELSE text END AS text FROM fronted)"""

_head = _q(X.HEADING_PATTERN)


def _sections(source: str) -> str:
    return f"""
split AS (SELECT doc_id, string_split_regex(text, {_head}) AS bodies, regexp_extract_all(text, {_head}) AS headers
  FROM {source}),
numbered AS (SELECT doc_id, headers, bodies, unnest(range(0, len(bodies))) AS ord FROM split),
sections AS MATERIALIZED (SELECT doc_id, CAST(ord AS INT) AS ord, CASE WHEN ord > 0 THEN headers[ord] END AS header,
  {_strip("bodies[ord + 1]")} AS body FROM numbered)"""


_CHUNKS = f"""
cut AS (
  SELECT doc_id, ord, header, body, unnest(range(0, length(body), 1800)) AS start FROM sections
  WHERE ord = 0 OR length(body) > 2000),
windows AS (SELECT doc_id, ord, header, start, {_strip("substring(body, CAST(start AS INT) + 1, 2000)")} AS segment FROM cut),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY start) AS nth FROM windows
  WHERE length(segment) > CASE WHEN ord = 0 THEN 100 ELSE 50 END),
chunks AS MATERIALIZED (
  SELECT doc_id, ord, CAST(nth - 1 AS INT) AS part, 'intro_' || (nth - 1) AS id, {_q(X.INTRO_SECTION)} AS section,
    segment AS text FROM kept WHERE ord = 0
  UNION ALL
  SELECT doc_id, ord, 0, replace(replace(lower(header), ' ', '_'), '-', '_'), header, header || chr(10) || body
    FROM sections WHERE ord > 0 AND length(body) <= 2000
  UNION ALL
  SELECT doc_id, ord, CAST(nth AS INT), replace(replace(lower(header), ' ', '_'), '-', '_') || '_part_' || nth,
    header || ' (Part ' || nth || ')', header || chr(10) || segment FROM kept WHERE ord > 0)"""
SECTIONS = f"{CORPUS}, {_sections('corpus')}"
CHUNKS = f"{SECTIONS}, {_CHUNKS}"

_n = "(1 + conv_id % 25)"
_question_forms = [
    f"'What does Regulation R-' || {_n} || ' say? ' || text", f"'Explain regulation r ' || {_n} || '. ' || text",
    f"'R0' || {_n} || ' ' || text", f"'What is O-' || {_n} || '? ' || text", f"'R_' || {_n} || ' ' || text",
    f"'XR-' || {_n} || ' is no regulation. ' || text", "'How many regulations are there? ' || text",
    "'What are the regulations on ' || text", "text", "CASE WHEN turn % 2 = 0 THEN '' END",
]
_title_forms = [
    f"' regulation r-' || {_n}", f"'R-' || {_n} || ' (part 2)'", "'Definitions ' || chr(10)", f"'o-' || {_n}", "text", "'  '",
]


def _case(form: str, forms: list[str]) -> str:
    return f"CASE {form} " + " ".join(f"WHEN {at} THEN {words}" for at, words in enumerate(forms)) + " END"


QUESTIONS = f"""
questions AS (SELECT conv_id || ':' || turn AS question_id,
  {_case(f"(conv_id * 3 + turn) % {len(_question_forms)}", _question_forms)} AS question FROM conversations)"""
TITLE_QUESTIONS = f"""
questions AS (SELECT conv_id || ':' || turn AS question_id,
  {_case(f"(conv_id + turn) % {len(_title_forms)}", _title_forms)} AS question FROM conversations)"""

# RE2 has no look-around: the neighbours are matched instead.
_requested = _q(rf"(?:^|[^A-Z0-9])(?:REGULATION{_WS}+)?([RO]){_WS}*[-_]?{_WS}*([0-9]+)(?:[^A-Z0-9]|$)")
REQUESTED = f"""
requested AS (SELECT question_id, question,
  CASE WHEN TRY_CAST(regexp_extract(upper(question), {_requested}, 2) AS BIGINT) IS NOT NULL
    THEN nullif(regexp_extract(upper(question), {_requested}, 1), '') END AS letter,
  TRY_CAST(regexp_extract(upper(question), {_requested}, 2) AS BIGINT) AS number FROM questions)"""
_section_id = _q(X.SECTION_ID_PATTERN)
REGULATIONS = f"""
titled AS (SELECT *, nullif(regexp_extract(upper(section), {_section_id}, 1), '') AS letter,
  TRY_CAST(regexp_extract(upper(section), {_section_id}, 2) AS BIGINT) AS number FROM chunks),
placed AS (SELECT *, dense_rank() OVER (PARTITION BY letter, number ORDER BY doc_id, ord) AS place FROM titled
  WHERE number IS NOT NULL),
regulations AS MATERIALIZED (SELECT * FROM placed WHERE place = 1)"""


def _tokens(name: str, source: str, keys: str, text: str) -> str:
    """(keys, bucket, n) and the squared length per key, for the texts of a table."""
    return f"""
{name}_words AS (SELECT {keys}, unnest(string_split_regex(lower(coalesce({text}, '')), '{_WS}+')) AS word FROM {source}),
{name}_counts AS MATERIALIZED (
  SELECT {keys}, CAST('0x' || substring(md5(word), 1, 8) AS BIGINT) % 384 AS bucket, count(*) AS n
  FROM {name}_words WHERE word <> '' GROUP BY ALL),
{name}_squares AS (SELECT {keys}, sum(n * n) AS squares FROM {name}_counts GROUP BY ALL)"""


def _nearest(asked: str, k: int, store: str = "chunks") -> str:
    """(question_id, rank, doc_id, ord, part, distance) for a table (question_id, question)."""
    return f"""{_tokens("q", asked, "question_id", "question")}, {_tokens("s", store, "doc_id, ord, part", "text")},
dots AS (
  SELECT question_id, doc_id, ord, part, sum(q_counts.n * s_counts.n) AS dot
  FROM q_counts JOIN s_counts USING (bucket) GROUP BY ALL),
q_all AS (SELECT question_id, CAST(coalesce(squares, 0) AS DOUBLE) AS q2 FROM {asked} LEFT JOIN q_squares USING (question_id)),
s_all AS (SELECT doc_id, ord, part, CAST(coalesce(squares, 0) AS DOUBLE) AS s2
  FROM {store} LEFT JOIN s_squares USING (doc_id, ord, part)),
pairs AS (
  SELECT question_id, doc_id, ord, part,
    (CASE WHEN q2 > 0 THEN 1e0 ELSE 0e0 END + CASE WHEN s2 > 0 THEN 1e0 ELSE 0e0 END)
      - 2e0 * (CAST(coalesce(dot, 0) AS DOUBLE) / CASE WHEN q2 * s2 > 0 THEN sqrt(q2 * s2) ELSE 1e0 END) AS d
  FROM q_all CROSS JOIN s_all LEFT JOIN dots USING (question_id, doc_id, ord, part)),
rounded AS (SELECT question_id, doc_id, ord, part, {_floor6("d")} AS distance FROM pairs),
near AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, doc_id, ord, part) AS rank
    FROM rounded) WHERE rank <= {k})"""


HYBRID = f"""{CHUNKS}, {QUESTIONS}, {REQUESTED}, {REGULATIONS},
others AS (SELECT question_id, question FROM requested r WHERE NOT EXISTS (
  SELECT 1 FROM regulations g WHERE g.letter = r.letter AND g.number = r.number)),
{_nearest("others", 3)},
hybrid AS MATERIALIZED (
  SELECT question_id, 'exact' AS route, CAST(greatest(part, 1) AS BIGINT) AS rank, doc_id, ord, part, section, text,
    0e0 AS distance FROM requested JOIN regulations USING (letter, number)
  UNION ALL
  SELECT question_id, 'nearest', rank, doc_id, ord, part, section, text, distance
  FROM near JOIN chunks USING (doc_id, ord, part))"""


def _answers(found: str) -> str:
    return f"""
answers AS (
  SELECT question_id, string_agg('[' || section || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank, doc_id, ord, part)
    AS context FROM {found} GROUP BY question_id),
first_seen AS (SELECT question_id, section, min(rank) AS rank FROM {found} GROUP BY question_id, section),
sources AS (SELECT question_id, list(section ORDER BY rank) AS sources FROM first_seen GROUP BY question_id)"""


_w = [
    ("coalesce(LIMIT_BAL, 0) <= 0", X.WARN_LIMIT), ("NOT coalesce(AGE, 0) BETWEEN 18 AND 100", X.WARN_AGE),
    ("EDUCATION IS NULL OR EDUCATION NOT IN (1, 2, 3, 4)", X.WARN_EDUCATION),
    ("MARRIAGE IS NULL OR MARRIAGE NOT IN (1, 2, 3)", X.WARN_MARRIAGE),
]
_warning_list = "list_filter([" + ", ".join(f"CASE WHEN {rule} THEN {_q(text)} END" for rule, text in _w) + \
    "], lambda w: w IS NOT NULL)"
CHECKED = f"""
checked AS (SELECT *, {_warning_list} AS warnings, coalesce(LIMIT_BAL, 0) > 2000000 AS {X.FLAG_CLEAN},
  coalesce(LIMIT_BAL, 0) > 5000000 AS {X.FLAG_AGGREGATE} FROM applicants)"""

_limit_text = "CASE WHEN LIMIT_BAL = floor(LIMIT_BAL) THEN CAST(CAST(LIMIT_BAL AS BIGINT) AS VARCHAR) || '.0' " \
    "ELSE regexp_replace(CAST(CAST(LIMIT_BAL AS DECIMAL(38,6)) AS VARCHAR), '0+$', '') END"
_template = X.QUESTION_TEMPLATE.split("%s")
ASKED = f"""{CONTRIBUTIONS}, {CHECKED},
asked AS MATERIALIZED (SELECT scored.*, warnings, {X.FLAG_CLEAN}, {X.FLAG_AGGREGATE},
  CASE WHEN {X.FLAG_AGGREGATE} THEN {_q(X.QUESTION_AGGREGATE)} WHEN {X.FLAG_CLEAN} THEN {_q(X.QUESTION_CLEAN)}
    ELSE {_q(_template[0])} || lower(risk_decision) || {_q(_template[1])} || {_limit_text.replace("LIMIT_BAL", "scored.LIMIT_BAL")}
      || {_q(_template[2])} END AS compliance_question
  FROM scored JOIN checked USING (applicant_id))"""


def _fixed(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', round({expr}, {digits}))"


_factor_text = f"""CASE WHEN impact > 0 THEN {_q(X.FACTOR_RAISES)} ELSE {_q(X.FACTOR_LOWERS)} END || feature || ': '
  || CASE WHEN impact < 0 THEN '-' ELSE '+' END || {_fixed("abs(impact)", 3)}"""
_warning_prefix = X.WARNING_LINE.split("%s")[0]
_report_head = X.REPORT.replace("%%", "%").split("%s")
REPORT_TEXT = " || ".join([
    _nl(_report_head[0]),
    f"coalesce(nullif(array_to_string(list_transform(warnings, lambda w: {_q(_warning_prefix)} || w), chr(10)), ''), {_q(X.NO_WARNINGS)})",
    _nl(_report_head[1]), "risk_decision", _nl(_report_head[2]), _fixed("risk_probability * 100", 1),
    _nl(_report_head[3]), "factor_lines", _nl(_report_head[4]), "coalesce(context, '')",
    _nl(_report_head[5]), "coalesce(array_to_string(sources, ', '), '')", _nl(_report_head[6]),
])
UNDERWRITTEN = f"""{ASKED}, {CHUNKS},
questions AS MATERIALIZED (SELECT DISTINCT compliance_question AS question_id, compliance_question AS question FROM asked),
{_nearest("questions", 3)},
found AS (SELECT question_id, rank, doc_id, ord, part, section, text FROM near JOIN chunks USING (doc_id, ord, part)),
{_answers("found")},
top5 AS (SELECT applicant_id, string_agg(feature, ', ' ORDER BY rank) AS factor_names,
  string_agg({_factor_text}, chr(10) ORDER BY rank) AS factor_lines,
  string_agg(feature || ' (' || CASE WHEN impact > 0 THEN 'raises' ELSE 'lowers' END || ' risk)', ', ' ORDER BY rank)
    AS memo_factors FROM ranked WHERE rank <= 5 GROUP BY applicant_id),
underwritten AS (
  SELECT asked.*, factor_names, factor_lines, context, sources, {REPORT_TEXT} AS final_report
  FROM asked JOIN top5 USING (applicant_id)
  LEFT JOIN answers ON answers.question_id = compliance_question
  LEFT JOIN sources ON sources.question_id = compliance_question)"""


def _add(name: str, ctes: str, select: str) -> None:
    ORACLE[name] = f"WITH {ctes}\n{select}" if ctes else select


# --- A ----------------------------------------------------------------------------------

_add("a1_applicant_csv_scan", APPLICANTS, "SELECT *, false AS is_bad FROM applicants")
_add("a1_scan_report", APPLICANTS, f"SELECT count(*) AS n_rows, 0 AS n_bad, {2 + len(X.BASE_COLUMNS)} AS n_columns FROM applicants")
for _name in ("a2_column_rename", "a3_attach_label", "a4_csv_sink", "d13_wide_history"):
    _add(_name, APPLICANTS, "SELECT * FROM applicants")
_add("a5_read_by_extension", "", "SELECT *, 'parquet' AS kind FROM labels UNION ALL SELECT *, 'csv' AS kind FROM labels")
_add("a6_front_matter_cut", CORPUS, "SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM corpus")
_add("a6_corpus_files", CORPUS, """SELECT length(text) + 1 AS n_chars, md5(text || chr(10)) AS digest FROM corpus""")
_add("a7_chunk_store", CHUNKS, f"SELECT doc_id, ord, part, id, section, md5(text) AS digest, {_q(X.CITATION)} AS source FROM chunks")

LOGGED = f"""{ASKED},
log AS (SELECT event_id AS id, ts AS decided_at, asked.*, (SELECT feature FROM ranked r
    WHERE r.applicant_id = asked.applicant_id AND rank = 1) AS top_feature
  FROM events JOIN asked ON user_id = applicant_id)"""
_add("a9_decision_log", LOGGED, """SELECT id, decided_at, strftime(decided_at, '%Y-%m-%d') AS decision_date, applicant_id,
  risk_probability, risk_decision, compliance_question, utilization_ratio, top_feature FROM log""")
_add("a10_recent_decisions", LOGGED, "SELECT id, decided_at, risk_decision, risk_probability FROM log ORDER BY id DESC LIMIT 20")

_drop = {c: f"(applicant_id % 7 = 0 AND applicant_id % 23 = {at})" for at, c in enumerate(X.BASE_COLUMNS)}
_nulls = ", ".join("CAST(NULL AS {}) AS {}".format(
    "DOUBLE" if c == "LIMIT_BAL" or "AMT" in c else "INT", c) for c in X.BASE_COLUMNS)
_add("a11_typed_requests", APPLICANTS, f"""SELECT 'a' || applicant_id AS request_id,
  NOT ({" OR ".join(_drop.values())}) AS valid,
  {", ".join(f"CASE WHEN NOT {rule} THEN {c} END AS {c}" for c, rule in _drop.items())} FROM applicants
UNION ALL SELECT 'e' || event_id, false, {_nulls} FROM events""")
_required = "[" + ", ".join(_q(c) for c in X.BASE_COLUMNS) + "]"
_missing = "list_filter([" + ", ".join(f"CASE WHEN {rule} THEN {_q(c)} END" for c, rule in _drop.items()) + \
    "], lambda w: w IS NOT NULL)"
_add("a12_required_fields", APPLICANTS, f"""SELECT request_id, len(missing) AS n_missing, array_to_string(missing, ', ') AS missing
FROM (SELECT 'a' || applicant_id AS request_id, {_missing} AS missing FROM applicants
  UNION ALL SELECT 'e' || event_id, {_required} FROM events)""")

# --- B ------------------------------------------------------------------------------------

_add("b1_shape", APPLICANTS, "SELECT count(*) AS n_rows, 25 AS n_columns FROM applicants")
_add("b2_preview", APPLICANTS, "SELECT * FROM applicants ORDER BY applicant_id LIMIT 5")
_add("b4_target_distribution", APPLICANTS, """SELECT target, count(*) AS n,
  round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct, round(count(*) / sum(count(*)) OVER (), 3) AS share
FROM applicants GROUP BY target""")
_joined = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
_add("b5_null_profile", "", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, "
    f"round(count(*) FILTER ({c} IS NULL) / count(*) * 100, 2) AS null_pct FROM documents LEFT JOIN labels USING (doc_id)"
    for c in _joined) + ") WHERE null_count > 0 ORDER BY null_pct DESC, column_name")


def _describe(c: str, digits: int) -> str:
    return f"""'{c}' AS column_name, count({c}) AS n, round({_mean(c)}, {digits}) AS mean,
  round(stddev_samp({c}), {digits}) AS stddev, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max"""


_add("b6_describe", APPLICANTS, " UNION ALL ".join(f"SELECT {_describe(c, 2)} FROM applicants" for c in ("LIMIT_BAL", "AGE")))
_HISTOGRAM = """
ranges AS (SELECT target, min(LIMIT_BAL) AS lo, max(LIMIT_BAL) AS hi FROM applicants GROUP BY target),
placed_bins AS (SELECT a.target, least(CAST(floor((LIMIT_BAL - lo) / ((hi - lo) / 50)) AS BIGINT), 49) AS bin
  FROM applicants a JOIN ranges USING (target)),
histogram AS (SELECT r.target, b.bin, round(lo + b.bin * ((hi - lo) / 50), 2) AS bin_start, count(p.bin) AS n
  FROM ranges r CROSS JOIN (SELECT unnest(range(0, 50)) AS bin) b
  LEFT JOIN placed_bins p ON p.target = r.target AND p.bin = b.bin GROUP BY ALL)"""
_add("b7_limit_histogram", f"{APPLICANTS}, {_HISTOGRAM}", "SELECT * FROM histogram")


def _rate(by: str, source: str = "applicants") -> str:
    return (f"SELECT {by}, count(*) AS total, round(sum(target) / count(target) * 100, 2) AS default_rate_pct "
            f"FROM {source} GROUP BY {by}")


_add("b8_rate_by_sex", APPLICANTS, _rate("SEX"))
_add("b9_rate_by_education", f"{APPLICANTS}, {RECODED}", _rate("EDUCATION", "recoded") + " ORDER BY default_rate_pct DESC, EDUCATION")
_add("b10_rate_by_status", APPLICANTS, _rate("PAY_0") + " ORDER BY PAY_0")
_pairs = [(a, b) for a in X.CORRELATION_COLUMNS for b in X.CORRELATION_COLUMNS]
_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, " + ("1e0" if a == b else f"round(corr({a}, {b}), 6)") + " AS corr FROM applicants"
    for a, b in _pairs).replace("1e0 AS corr FROM applicants", "1e0 AS corr")
_add("b11_correlation", APPLICANTS, _CORR)
_add("b12_dataset_summary", APPLICANTS, " UNION ALL ".join(
    f"SELECT {_describe(c, 3)}, " + ", ".join(
        f"round(quantile_cont(CAST({c} AS DOUBLE), {share}), 3) AS {name}"
        for share, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))) + " FROM applicants"
    for c in [*X.BASE_COLUMNS, X.TARGET]))

# --- C --------------------------------------------------------------------------------------

_add("c1_education_recode", f"{APPLICANTS}, {RECODED}", "SELECT applicant_id, EDUCATION FROM recoded")
_add("c2_marriage_recode", f"{APPLICANTS}, {RECODED}", "SELECT applicant_id, MARRIAGE FROM recoded")
_add("c3_validation", f"{APPLICANTS}, {CHECKED}",
     "SELECT applicant_id, len(warnings) AS n_warnings, array_to_string(warnings, '; ') AS warnings FROM checked")
_add("c4_cap_flags", f"{APPLICANTS}, {CHECKED}", f"SELECT applicant_id, {X.FLAG_CLEAN}, {X.FLAG_AGGREGATE} FROM checked")
_add("c5_limit_against_caps", APPLICANTS, " UNION ALL ".join(
    f"SELECT applicant_id, {_q(label)} AS label, {amount} AS amount FROM applicants"
    for label, amount in zip(X.CAP_LABELS, ("LIMIT_BAL", "2000000e0", "5000000e0"))))


def _label(c: str, labels: dict[int, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in labels.items()) + " ELSE 'Unknown' END"


_add("c6_code_labels", f"{APPLICANTS}, {RECODED}", f"""SELECT *, sex_label || ', ' || age_text || ' years old, ' || education_label
  || ', ' || marriage_label AS summary_line FROM (SELECT applicant_id, {_label("SEX", X.SEX_LABELS)} AS sex_label,
  {_label("EDUCATION", X.EDUCATION_LABELS)} AS education_label, {_label("MARRIAGE", X.MARRIAGE_LABELS)} AS marriage_label,
  coalesce(CAST(AGE AS VARCHAR), 'Unknown') AS age_text FROM recoded)""".replace("SELECT *,", "SELECT * EXCLUDE (age_text),"))
_add("c7_quality_rollup", f"{APPLICANTS}, {CHECKED}", f"""SELECT finding, count(*) AS applicants FROM (
  SELECT unnest(CASE WHEN len(f) = 0 THEN ['None'] ELSE f END) AS finding FROM (
    SELECT list_concat(warnings, list_filter([CASE WHEN {X.FLAG_CLEAN} THEN '{X.FLAG_CLEAN}' END,
      CASE WHEN {X.FLAG_AGGREGATE} THEN '{X.FLAG_AGGREGATE}' END], lambda w: w IS NOT NULL)) AS f FROM checked))
GROUP BY finding""")
_add("c7_warning_counts", f"{APPLICANTS}, {CHECKED}",
     f"SELECT applicant_id, len(warnings) AS n_warnings, {X.FLAG_CLEAN} AS clean_cap_exceeded FROM checked")

# --- D ----------------------------------------------------------------------------------------

for _name, _select in {
    "d1_row_sum": f"{_status} AS status_sum, {_bills} AS billed",
    "d2_avg_bill": f"({_bills}) / 6 AS avg_bill_amt",
    "d3_utilization": f"round((({_bills}) / 6) / nullif(LIMIT_BAL, 0), 4) AS training, {D['utilization_ratio']} AS serving",
    "d4_avg_pay_delay": f"{D['avg_pay_delay']} AS avg_pay_delay",
    "d5_max_pay_delay": f"{D['max_pay_delay']} AS max_pay_delay",
    "d6_months_late": f"{D['months_late']} AS months_late",
    "d7_totals": f"{_paid} AS total_paid_6m, {_bills} AS total_billed_6m",
    "d8_payment_ratio": f"{D['payment_ratio']} AS payment_ratio",
    "d9_delay_trend": f"{D['delay_trend']} AS delay_trend",
}.items():
    _add(_name, APPLICANTS, f"SELECT applicant_id, {_select} FROM applicants")
TABLE = "SELECT * REPLACE (CASE WHEN LIMIT_BAL <> 0 THEN utilization_ratio END AS utilization_ratio) FROM features"
_add("d10_feature_table", FEATURES, TABLE)
_add("d11_history_long", APPLICANTS, " UNION ALL ".join(
    f"SELECT applicant_id, {at} AS month_no, '{label}' AS month, {bill} AS bill, {paid} AS paid, {status} AS status FROM applicants"
    for at, (label, bill, paid, status) in enumerate(
        zip(X.MONTH_LABELS, X.BILL_COLUMNS[::-1], X.PAID_COLUMNS[::-1], X.STATUS_COLUMNS[::-1]), 1)))
_add("d12_engineered_table", FEATURES, " UNION ALL ".join(
    f"SELECT applicant_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM features" for c in X.ENGINEERED_COLUMNS))

# --- E ------------------------------------------------------------------------------------------


def _split(source: str, key: str, label: str) -> str:
    return f"""shuffled AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5({key} || ':42'), {key}) AS place,
  count(*) OVER (PARTITION BY {label}) AS n_class FROM {source}),
parts AS (SELECT {key}, {label}, CASE WHEN place <= round(0.2e0 * n_class) THEN 'test' ELSE 'train' END AS split,
  CAST((place - 1) % 5 AS INT) AS fold FROM shuffled)"""


_SPLIT = f"{APPLICANTS}, {_split('applicants', 'applicant_id', 'target')}"
_add("e1_stratified_split", _SPLIT, "SELECT applicant_id, target, split FROM parts")
_add("e1_label_split", _split("labels", "doc_id", "quality"), "SELECT doc_id, quality, split FROM parts")
_add("e2_split_report", _SPLIT, "SELECT split, count(*) AS n, round(sum(target) / count(*) * 100, 1) AS default_pct FROM parts GROUP BY split")
_add("e3_stratified_folds", _SPLIT, "SELECT applicant_id, target, fold FROM parts")
_add("f3_fold_coverage", _SPLIT, "SELECT applicant_id, target, fold FROM parts")
_add("f1_decisions", _SPLIT, "SELECT applicant_id, target, true AS decided FROM parts WHERE split = 'test'")
_add("f2_fold_sizes", _SPLIT, """SELECT CAST(trial AS INT) AS trial, fold, count(*) FILTER (target = 1) AS positives,
  count(*) FILTER (target = 0) AS negatives, true AS has_auc, 9 AS n_inside FROM parts, range(3) AS trials(trial) GROUP BY trial, fold""")
_add("f11_bundle_round_trip", APPLICANTS, "SELECT count(*) AS n_applicants, 0 AS n_different, 0.55e0 AS threshold FROM applicants")
_add("g1_contributions_add_up", APPLICANTS, "SELECT count(*) AS n_applicants, 0 AS n_off FROM applicants")
_add("e4_class_weight", APPLICANTS, """SELECT count(*) FILTER (target = 0) AS negatives, count(*) FILTER (target = 1) AS positives,
  round(count(*) FILTER (target = 0) / count(*) FILTER (target = 1), 6) AS scale_pos_weight FROM applicants""")

# --- F --------------------------------------------------------------------------------------------

_add("f4_score_and_decide", SCORED, "SELECT applicant_id, risk_probability, risk_decision FROM scored")


def _sweep(thresholds: list[str]) -> str:
    return f"""
steps AS (SELECT unnest([{", ".join(thresholds)}]) AS threshold),
cells AS (SELECT threshold, count(*) FILTER (risk_probability >= threshold AND target = 1) AS tp,
  count(*) FILTER (risk_probability >= threshold AND target = 0) AS fp,
  count(*) FILTER (risk_probability < threshold AND target = 1) AS fn,
  count(*) FILTER (risk_probability < threshold AND target = 0) AS tn FROM steps CROSS JOIN scored GROUP BY threshold),
sweep AS (SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  coalesce(round(tp / nullif(tp + fp, 0), 6), 0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 6), 0) AS recall,
  coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) AS f1_score FROM cells)"""


_SWEEP = f"{SCORED}, {_sweep([f'{p} / 100e0' for p in range(20, 81)])}"
_add("f5_threshold_sweep", _SWEEP, "SELECT * FROM sweep")
_add("f5_best_threshold", _SWEEP, """SELECT threshold, f1_score FROM sweep
ORDER BY 2 * tp / nullif(2 * tp + fp + fn, 0) DESC NULLS LAST, threshold LIMIT 1""")
_TABLE6 = f"{SCORED}, {_sweep([f'{t}e0' for t in X.TABLE_THRESHOLDS])}"
_add("f6_threshold_table", _TABLE6, """SELECT threshold, round(accuracy, 4) AS accuracy, round(precision, 4) AS precision,
  round(recall, 4) AS recall, round(f1_score, 4) AS f1_score, abs(threshold - 0.55e0) < 0.01e0 AS is_current FROM sweep""")
AUC = """
by_score AS (SELECT risk_probability AS s, count(*) FILTER (target = 1) AS pos, count(*) FILTER (target = 0) AS neg
  FROM scored GROUP BY ALL),
below AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM by_score),
auc AS (SELECT round(sum(CAST(pos * (2 * neg_below + neg) AS DOUBLE)) / (2 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6)
  AS roc_auc FROM below)"""
NAIVE = "naive AS (SELECT round(max(n) / sum(n), 6) AS naive_baseline FROM (SELECT count(*) AS n FROM scored GROUP BY target))"
_METRICS = f"{SCORED}, {_sweep(['0.55e0'])}, {AUC}, {NAIVE}"
for _name in ("f7_metrics", "a8_metrics_sink"):
    _add(_name, _METRICS, "SELECT accuracy, precision, recall, f1_score, roc_auc, naive_baseline FROM sweep, auc, naive")
_add("f8_confusion_matrix", SCORED, """SELECT a.actual, p.predicted,
  (SELECT count(*) FROM scored WHERE target = a.actual AND CAST(risk_probability >= 0.55e0 AS INT) = p.predicted) AS n
FROM (SELECT unnest([0, 1]) AS actual) a CROSS JOIN (SELECT unnest([0, 1]) AS predicted) p""")
_add("f9_roc_auc", f"{SCORED}, {AUC}", "SELECT roc_auc FROM auc")
_add("f10_naive_baseline", f"{SCORED}, {NAIVE}", "SELECT naive_baseline FROM naive")

# --- G ------------------------------------------------------------------------------------------------

_add("g2_linear_contributions", CONTRIBUTIONS, "SELECT applicant_id, feature, impact, value FROM contributions")
_add("g4_top_factors", CONTRIBUTIONS, "SELECT applicant_id, rank, feature, impact, value FROM ranked WHERE rank <= 8")
_DISPLAY = "CASE feature " + " ".join(
    f"WHEN '{c}' THEN {_q(c.replace('_encoded', '').replace('_', ' ').title())}" for c in X.FEATURE_COLUMNS) + " END"
_add("g5_global_importance", CONTRIBUTIONS, f"""SELECT row_number() OVER (ORDER BY m DESC, pos) AS rank, feature,
  {_DISPLAY} AS display_name, m AS mean_abs_impact
FROM (SELECT pos, feature, round({_mean("abs(impact)")}, 6) AS m FROM contributions GROUP BY pos, feature)
ORDER BY rank LIMIT 10""")
_add("g6_category_impact", CONTRIBUTIONS, " UNION ALL ".join(
    f"SELECT applicant_id, {_q(name)} AS category, round(coalesce(sum(impact) FILTER (feature IN "
    f"({', '.join(_q(m) for m in members)})), 0), 6) AS impact FROM contributions GROUP BY applicant_id"
    for name, members in X.FEATURE_CATEGORIES.items()))
_add("g7_extremes", SCORED, """(SELECT 'riskiest' AS kind, applicant_id, risk_probability FROM scored
  ORDER BY risk_probability DESC, applicant_id LIMIT 1)
UNION ALL (SELECT 'safest', applicant_id, risk_probability FROM scored ORDER BY risk_probability, applicant_id LIMIT 1)""")
_add("g8_direction", CONTRIBUTIONS, f"""SELECT applicant_id, rank, {_DISPLAY} AS display_name,
  CASE WHEN impact > 0 THEN 'raises' ELSE 'lowers' END AS direction FROM ranked WHERE rank <= 6""")
_add("g9_summary_points", CONTRIBUTIONS, "SELECT feature, value, impact FROM contributions")

# --- H ---------------------------------------------------------------------------------------------------

_add("h1_sections", SECTIONS, "SELECT doc_id, ord, header, length(body) AS n_chars, md5(body) AS digest FROM sections")
_add("h2_intro_windows", f"{_sections('documents')}, {_CHUNKS}",
     "SELECT doc_id, part, id, length(text) AS n_chars, md5(text) AS digest FROM chunks")
_add("h3_section_windows", CHUNKS, "SELECT doc_id, ord, part, length(text) AS n_chars, md5(text) AS digest FROM chunks WHERE ord > 0")
_add("h4_chunk_labels", CHUNKS, f"SELECT doc_id, ord, part, id, section, {_q(X.CITATION)} AS source FROM chunks")
_add("h5_hashed_vectors", _tokens("t", "conversations", "conv_id, turn", "text"), """SELECT conv_id, turn, bucket, n,
  round(n / sqrt(CAST(squares AS DOUBLE)), 6) AS weight FROM t_counts JOIN t_squares USING (conv_id, turn)""")
_add("h6_vectors_for_table", _tokens("t", "benchmark", "item_id", "text"), """SELECT key, dim, round(CAST(v AS DOUBLE), 5) AS weight FROM (
  SELECT 'e' || vec_id AS key, unnest(range(0, len(embedding))) AS dim, unnest(embedding) AS v FROM embeddings
  UNION ALL SELECT 'b' || item_id, bucket, CAST(n / sqrt(CAST(squares AS DOUBLE)) AS FLOAT) FROM t_counts JOIN t_squares USING (item_id)
) WHERE v <> 0""")
_add("h7_nearest_vectors", """
vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT q.vec_id AS question_id, s.vec_id,
  list_inner_product(q.v, q.v) + list_inner_product(s.v, s.v) - 2e0 * list_inner_product(q.v, s.v) AS d
  FROM vectors q CROSS JOIN vectors s),
rounded AS (SELECT question_id, vec_id, floor(d * 1e6 + 0.5e0) / 1e6 AS distance FROM pairs)""",
     """SELECT * FROM (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY distance, vec_id) AS rank,
  vec_id, distance FROM rounded) WHERE rank <= 5""")
_add("h7_nearest_chunks", f"""{CHUNKS},
questions AS (SELECT CAST(item_id AS VARCHAR) AS question_id, text AS question FROM benchmark), {_nearest("questions", 3)}""",
     "SELECT question_id, rank, doc_id, ord, part, distance FROM near")
_add("h8_requested_regulation", f"{QUESTIONS}, {REQUESTED}", "SELECT question_id, letter, number FROM requested")
_add("h9_exact_lookup", f"{CHUNKS}, {QUESTIONS}, {REQUESTED}, {REGULATIONS}", """SELECT question_id, greatest(part, 1) AS rank,
  doc_id, ord, part, section, md5(text) AS digest FROM requested JOIN regulations USING (letter, number)""")
_add("h10_hybrid_route", HYBRID, "SELECT question_id, route, rank, doc_id, ord, part, section, distance FROM hybrid")
_overview = X.OVERVIEW_ANSWER.split("%d")
_add("h11_overview", f"""{CHUNKS}, {QUESTIONS}, {REGULATIONS},
sizes AS (SELECT count(*) AS total, count(*) FILTER (letter = 'R') AS r, count(*) FILTER (letter = 'O') AS o
  FROM (SELECT DISTINCT letter, number FROM regulations))""",
     f"""SELECT question_id, {_nl(_overview[0])} || total || {_nl(_overview[1])} || r || {_nl(_overview[2])} || o
  || {_nl(_overview[3])} AS answer, {_q(X.OVERVIEW_SOURCE)} AS sources FROM questions, sizes
WHERE regexp_matches(question, {_q(X.OVERVIEW_PATTERN)})""")
_add("h12_applicant_question", ASKED, "SELECT applicant_id, compliance_question FROM asked")
_add("h13_context", f"{HYBRID}, {_answers('hybrid')}",
     "SELECT question_id, length(context) AS n_chars, md5(context) AS digest FROM answers")
_add("h14_sources", f"{HYBRID}, {_answers('hybrid')}", "SELECT question_id, array_to_string(sources, '; ') AS sources FROM sources")
_add("h15_title_match", f"""{CHUNKS}, {TITLE_QUESTIONS}, {_nearest("questions", 3)},
wanted AS (SELECT question_id, lower({_strip("question")}) AS piece FROM questions),
matched AS (SELECT question_id, doc_id, ord, part, section,
  row_number() OVER (PARTITION BY question_id ORDER BY doc_id, ord, part) AS nth
  FROM wanted JOIN chunks ON contains(lower(section), piece) WHERE piece <> '')""",
     """SELECT question_id, 0 AS rank, doc_id, ord, part, section, 0e0 AS distance FROM matched WHERE nth = 1
UNION ALL SELECT question_id, rank, doc_id, ord, part, section, distance FROM near JOIN chunks USING (doc_id, ord, part)""")
_add("h16_citation_check", f"""{CORPUS},
cited AS (SELECT doc_id, list_distinct(regexp_extract_all(upper(text), {_head})) AS cites FROM corpus),
judged AS (SELECT doc_id, list_sort(list_filter(cites, lambda c: c <> 'REGULATION R-' || (1 + doc_id % 7)
  AND c <> 'REGULATION O-' || (1 + doc_id % 16))) AS missing FROM cited)""",
     "SELECT doc_id, len(missing) = 0 AS supported, array_to_string(missing, '; ') AS unsupported FROM judged")

# --- I and J ------------------------------------------------------------------------------------------------

_add("i1_report", UNDERWRITTEN, "SELECT applicant_id, final_report FROM underwritten")
_add("i2_memo_facts", f"""{ASKED},
memo AS (SELECT applicant_id, string_agg(feature || ' (' || CASE WHEN impact > 0 THEN 'raises' ELSE 'lowers' END || ' risk)', ', '
  ORDER BY rank) AS factors FROM ranked WHERE rank <= 5 GROUP BY applicant_id)""",
     f"""SELECT applicant_id, 'Decision: ' || risk_decision || chr(10) || 'Default probability: '
  || {_fixed("risk_probability * 100", 1)} || '%' || chr(10) || 'Key factors: ' || factors || chr(10)
  || 'Compliance findings: ' || compliance_question AS memo_facts FROM asked JOIN memo USING (applicant_id)""")
_add("j1_portfolio_underwriting", UNDERWRITTEN, f"""SELECT applicant_id, array_to_string(warnings, '; ') AS data_warnings,
  {X.FLAG_CLEAN}, {X.FLAG_AGGREGATE}, {_cols(X.ENGINEERED_COLUMNS)}, risk_probability, risk_decision,
  factor_names AS top_risk_factors, compliance_question, array_to_string(sources, '; ') AS compliance_sources,
  md5(final_report) AS report_digest FROM underwritten""")
_add("j2_streaming_underwriting", UNDERWRITTEN, """SELECT applicant_id AS id, applicant_id, risk_probability, risk_decision,
  compliance_question, array_to_string(sources, '; ') AS compliance_sources FROM underwritten""")
_add("j3_feature_job", f"{FEATURES}, {_split('features', 'applicant_id', 'target')}",
     f"SELECT t.*, split FROM ({TABLE}) t JOIN parts USING (applicant_id)")
_add("j4_corpus_job", f"{CHUNKS}, {_tokens('t', 'chunks', 'doc_id, ord, part', 'text')}", """
SELECT doc_id, ord, part, id, section, md5(text) AS digest, coalesce(n_words, 0) AS n_words FROM chunks
LEFT JOIN (SELECT doc_id, ord, part, CAST(sum(n) AS BIGINT) AS n_words FROM t_counts GROUP BY ALL) USING (doc_id, ord, part)""")
_add("j5_profile_job", f"{APPLICANTS}, {_HISTOGRAM}, correlations AS ({_CORR})", f"""
SELECT 'shape' AS report, 'rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM applicants
UNION ALL SELECT 'classes', CAST(target AS VARCHAR), round(count(*) / sum(count(*)) OVER () * 100, 2) FROM applicants GROUP BY target
UNION ALL SELECT 'describe', column_name, mean FROM (SELECT {_describe("LIMIT_BAL", 2)} FROM applicants
  UNION ALL SELECT {_describe("AGE", 2)} FROM applicants)
UNION ALL SELECT 'limit_histogram', target || '/' || bin, n FROM histogram
UNION ALL SELECT 'rate_by_sex', CAST(SEX AS VARCHAR), default_rate_pct FROM ({_rate("SEX")})
UNION ALL SELECT 'rate_by_education', CAST(EDUCATION AS VARCHAR), default_rate_pct FROM ({_rate("EDUCATION")})
UNION ALL SELECT 'rate_by_status', CAST(PAY_0 AS VARCHAR), default_rate_pct FROM ({_rate("PAY_0")})
UNION ALL SELECT 'correlation', col_a || '/' || col_b, corr FROM correlations""")

_add("j1_citation_check", UNDERWRITTEN, f"""SELECT applicant_id, len(missing) = 0 AS supported, array_to_string(missing, '; ') AS unsupported
FROM (SELECT applicant_id, list_sort(list_filter(list_distinct(regexp_extract_all(upper(final_report), {_head})), lambda c: NOT list_contains(
  list_transform(sources, lambda s: regexp_replace(upper(s), ' \\(PART [0-9]+\\)$', '')), c))) AS missing FROM underwritten)""")
_add("j1_underwriting_by_model", ASKED, f"""SELECT applicant_id, array_to_string(warnings, '; ') AS data_warnings, {_cols(X.ENGINEERED_COLUMNS)},
  true AS decided, true AS adds_up, 5 AS n_factors, true AS answered FROM asked""")
_add("j2_streaming_by_model", APPLICANTS, """SELECT applicant_id AS id, applicant_id, true AS decided,
  'requests-' || applicant_id % 2 AS batch_id, 5 AS n_factors FROM applicants""")
_add("j6_training_job", f"{FEATURES}, {_split('(SELECT * FROM features WHERE LIMIT_BAL <> 0)', 'applicant_id', 'target')}, train AS ("
     "SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5(applicant_id || ':42'), applicant_id) - 1 AS nth FROM parts WHERE split = 'train')",
     """SELECT applicant_id, target, split, CAST(nth % 5 AS INT) AS fold, true AS decided FROM train
UNION ALL SELECT applicant_id, target, split, NULL, true FROM parts WHERE split = 'test'""")
_add("j7_explain_job", f"{FEATURES}, {_split('features', 'applicant_id', 'target')}", f"""SELECT applicant_id, feature, value FROM (
  SELECT applicant_id, unnest([{", ".join(_q(c) for c in X.FEATURE_COLUMNS)}]) AS feature,
    unnest([{", ".join(f"CAST({c} AS DOUBLE)" for c in X.FEATURE_COLUMNS)}]) AS value
  FROM features JOIN parts USING (applicant_id, target) WHERE split = 'test')""")
_add("j8_question_job", f"""{CHUNKS}, {TITLE_QUESTIONS}, {_nearest("questions", 3)},
wanted AS (SELECT question_id, lower({_strip("question")}) AS piece FROM questions),
matched AS (SELECT question_id, doc_id, ord, part, section, text,
  row_number() OVER (PARTITION BY question_id ORDER BY doc_id, ord, part) AS nth
  FROM wanted JOIN chunks ON contains(lower(section), piece) WHERE piece <> ''),
results AS (SELECT question_id, CAST(0 AS BIGINT) AS rank, doc_id, ord, part, section, text FROM matched WHERE nth = 1
  UNION ALL SELECT question_id, rank, doc_id, ord, part, section, text FROM near JOIN chunks USING (doc_id, ord, part)),
{_answers("results")}""", """SELECT question_id, length(context) AS n_chars, md5(context) AS digest, array_to_string(sources, '; ') AS sources
FROM answers JOIN sources USING (question_id)""")
_add("b12_sample_rows", APPLICANTS, f"""SELECT row, column_name, value FROM (
  SELECT row, unnest([{", ".join(_q(c) for c in [*X.BASE_COLUMNS, X.TARGET])}]) AS column_name,
    unnest([{", ".join(f"CAST({c} AS VARCHAR)" for c in [*X.BASE_COLUMNS, X.TARGET])}]) AS value
  FROM (SELECT *, CAST(row_number() OVER (ORDER BY applicant_id) AS INT) AS row FROM applicants) WHERE row <= 5)""")
