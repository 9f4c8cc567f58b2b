"""SQL of the numbered queries whose whole result SQL can express on whole tables."""

from __future__ import annotations

from braggflow.llm import quality
from braggflow.llm.common import LOWER, UPPER

_LOWER = lambda text: f"translate({text}, '{UPPER}', '{LOWER}')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_VISIBLE = r"[^\x20\x09-\x0D]+"

OP5 = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all({_LOWER("coalesce(text, '')")}, '{_ALNUM}') AS ws FROM documents),
items AS (SELECT item_id, ws, least(13, len(ws)) AS k FROM (SELECT item_id, regexp_extract_all({_LOWER("coalesce(text, '')")}, '{_ALNUM}') AS ws FROM benchmark)),
grams AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM items WHERE k > 0)),
sizes AS (SELECT DISTINCT k FROM grams),
windows AS (SELECT n, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT n, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, sizes WHERE len(ws) >= k)),
hits AS (SELECT n, k, i, item_id FROM windows JOIN grams USING (k, gram)),
words_hit AS (SELECT n, count(DISTINCT place) AS n_hit FROM (SELECT n, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT n, k, i FROM hits)) GROUP BY n),
items_hit AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY n)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN words_hit USING (n) LEFT JOIN items_hit USING (n)"""

_W = quality.WINDOW
OP7 = rf"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, source AS host, text AS given, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '{_VISIBLE}') AS ws FROM docs),
windows AS (SELECT n, i, array_to_string(ws[i:i + {_W - 1}], ' ') AS gram FROM (SELECT n, ws, unnest(range(1, len(ws) - {_W - 2})) AS i FROM words WHERE len(ws) > {_W})),
twice AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, gram) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT n, count(DISTINCT place) AS n_repeat_words FROM (SELECT n, unnest(range(i, i + {_W})) AS place FROM twice) GROUP BY n),
lines AS (SELECT n, nr, host, given, line, regexp_extract_all(line, '{_VISIBLE}') AS ws
  FROM (SELECT n, host, given, generate_subscripts(ls, 1) - 1 AS nr, unnest(ls) AS line FROM (SELECT n, host, given, string_split(text, chr(10)) AS ls FROM docs))),
full_lines AS (SELECT n, nr, host, given, line, {_LOWER("array_to_string(ws, ' ')")} AS norm, len(ws) AS w FROM lines WHERE len(ws) > 0),
dups AS (SELECT n, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY n),
hosts AS (SELECT coalesce(host, chr(0)) AS h, count(DISTINCT given) + max(CASE WHEN given IS NULL THEN 1 ELSE 0 END) AS host_docs FROM docs GROUP BY 1),
often AS (SELECT coalesce(host, chr(0)) AS h, norm, count(DISTINCT given) AS c FROM full_lines GROUP BY 1, 2),
over_ AS (SELECT h, norm FROM often JOIN hosts USING (h) WHERE c > {quality.MIN_DOCS} OR (c > {quality.SHARE_DOCS} AND c > CAST({quality.MAX_SHARE} AS DOUBLE) * host_docs)),
gone AS (SELECT n, CAST(sum(w) AS BIGINT) AS gone, string_agg(CAST(nr AS VARCHAR), ',' ORDER BY nr) AS removed FROM full_lines f JOIN over_ o ON coalesce(f.host, chr(0)) = o.h AND f.norm = o.norm GROUP BY n),
facts AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0) AS gone, coalesce(removed, '') AS removed_lines
  FROM words LEFT JOIN repeats USING (n) LEFT JOIN dups USING (n) LEFT JOIN gone USING (n))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_lines, gone AS removed_words,
  n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_SHARE} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_SHARE} * n_words) AND n_words - gone >= CAST({quality.MIN_LEFT} AS DOUBLE) * n_words AS kept
FROM facts"""


_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_SHARE = lambda n, whole: f"CAST(1 + 1000000000::HUGEINT * ({n} + 1) // ({whole}) AS HUGEINT)"
OP12 = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER("coalesce(text, '')")} AS text FROM documents),
found AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '{_TERM}')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY 1, 2 HAVING count(DISTINCT d) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM found SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
sizes AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, {_SHARE("coalesce(c.c, 0)", "s.n + l.v")} AS p, {_SHARE("k.n", "l.n + l.v")} AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 200"""
