"""DuckDB SQL for the operators that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
span AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS words
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
place AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM span) WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, place.n, item_id FROM place JOIN span USING (words) WHERE place.n = span.n),
covered AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS spot FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _pour(source: str, parent: list[str], name: str) -> str:
    """Shares `budget` among the children of each node of `source` (.., capacity, weight, budget)."""
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    order = f"ORDER BY CASE WHEN weight = 0 THEN 1 ELSE 0 END, CASE WHEN weight > 0 THEN CAST(capacity AS DOUBLE) / weight END NULLS FIRST, {name} NULLS FIRST"
    window = f"({by} {order}"
    return f"""
      SELECT * EXCLUDE (room, open_weight, fits, filled, rest, total, upto, own), CAST(CASE WHEN filled THEN capacity
        WHEN total > 0 THEN rest * upto // total - rest * (upto - own) // total ELSE 0 END AS BIGINT) AS granted
      FROM (
        SELECT *, greatest(0, budget - coalesce(sum(CASE WHEN filled THEN capacity END) OVER ({by}), 0))::HUGEINT AS rest,
          (sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({by}))::HUGEINT AS total,
          (sum(CASE WHEN filled THEN 0 ELSE weight END) OVER {window} ROWS UNBOUNDED PRECEDING))::HUGEINT AS upto,
          (CASE WHEN filled THEN 0 ELSE weight END)::HUGEINT AS own
        FROM (
          SELECT *, bool_and(fits) OVER {window} ROWS UNBOUNDED PRECEDING) AS filled
          FROM (
            SELECT *, weight > 0 AND capacity::HUGEINT * open_weight <= room * weight AS fits
            FROM (
              SELECT *, (budget - coalesce(sum(capacity) OVER {window} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT AS room,
                (sum(weight) OVER {window} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS open_weight
              FROM ({source})))))"""


#: Written for the tree and the weights of the query: domain, language, source; 4 epochs; seed 42.
MIXTURE = f"""
WITH d AS (
  SELECT doc_id, lang, source,
    CASE number % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'other' END AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM (SELECT *, TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS number FROM documents)),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, 4 * sum(n_tokens)::BIGINT AS capacity FROM d GROUP BY ALL),
top AS ({_pour("""
  SELECT domain, CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END AS weight,
    sum(capacity)::BIGINT AS capacity, (SELECT sum(supply) FROM leaf)::BIGINT AS budget FROM leaf GROUP BY domain""", [], "domain")}),
middle AS ({_pour("""
  SELECT leaf.domain, lang, CASE WHEN leaf.domain = 'web' AND lang = 'en' THEN 3 WHEN leaf.domain = 'books' AND lang = 'en' THEN 2 ELSE 1 END AS weight,
    sum(leaf.capacity)::BIGINT AS capacity, max(granted) AS budget
  FROM leaf JOIN top ON leaf.domain = top.domain GROUP BY ALL""", ["domain"], "lang")}),
bottom AS ({_pour("""
  SELECT leaf.domain, leaf.lang, source, supply, CASE WHEN leaf.domain = 'web' AND leaf.lang = 'en' AND source = 'src0' THEN 2 ELSE 1 END AS weight,
    leaf.capacity, granted AS budget
  FROM leaf JOIN middle ON leaf.domain = middle.domain AND leaf.lang IS NOT DISTINCT FROM middle.lang""", ["domain", "lang"], "source")}),
budgets AS (
  SELECT *, CASE WHEN supply > 0 THEN granted // supply ELSE 0 END AS full_epochs,
    granted - CASE WHEN supply > 0 THEN granted // supply ELSE 0 END * supply AS rest
  FROM bottom),
placed AS (
  SELECT d.*, granted, full_epochs, rest, md5('42|' || full_epochs || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM d JOIN budgets b ON d.domain = b.domain AND d.lang IS NOT DISTINCT FROM b.lang AND d.source IS NOT DISTINCT FROM b.source),
summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place)
    - sum(n_tokens) OVER (PARTITION BY domain, lang, source, place) AS ahead
  FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, granted,
  CAST(full_epochs + CASE WHEN ahead < rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM summed
"""


_NO_GAP = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOP_K = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_NO_GAP}),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

COLLOCATIONS = f"""
WITH piece AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY lang),
spot AS (
  SELECT lang, m, array_to_string(w[p : p + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM piece, range(1, 5) AS sizes(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM spot GROUP BY ALL HAVING count(*) >= 30),
candidate AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cut AS (
  SELECT lang, m, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : m], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidate)),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, cut.k, x.a AS l, y.a AS r,
    CAST(CAST(2000000 AS HUGEINT) * cut.a // (x.a + y.a) AS BIGINT) AS score
  FROM cut JOIN f AS x ON x.lang = cut.lang AND x.phrase = cut.head JOIN f AS y ON y.lang = cut.lang AND y.phrase = cut.tail),
lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS turn FROM scored) WHERE turn = 1),
part AS (
  SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS a
  FROM (SELECT lang, a, w, s, unnest(range(1, m - s + 2)) AS i FROM candidate, range(2, 4) AS sizes(s) WHERE s < m) GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN part ON part.lang = lowest.lang AND part.phrase = lowest.phrase
  WHERE part.a IS NULL OR CAST(100 AS HUGEINT) * part.a < CAST(80 AS HUGEINT) * lowest.a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang)
WHERE rank <= 2000
"""
