"""DuckDB SQL for the queries whose rows SQL can state."""

from __future__ import annotations

from boutline.llm import quality

_R = quality.Rules()
_WORD = r"'[^\x20\x09-\x0D]+'"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
x AS (SELECT doc_id, i, ws[i:i + 12] AS win FROM w, unnest(range(1, len(ws) - 11)) AS r(i)),
f AS (SELECT win, MIN(doc_id) AS first_doc FROM x GROUP BY win),
g AS (SELECT DISTINCT doc_id, p FROM (SELECT x.doc_id, unnest(range(x.i, x.i + 13)) AS p FROM x JOIN f ON x.win = f.win WHERE f.first_doc < x.doc_id)),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT e.doc_id, COUNT(g.p) AS gone, string_agg(CASE WHEN g.p IS NULL THEN e.word END, ' ' ORDER BY e.p) AS kept FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), {_WORD}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS both_n FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * both_n >= 75 * (x.n + y.n - both_n)),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.doc_id)
SELECT c.doc_id, coalesce(MAX(n.n), 0) AS n_shingles, MIN(r) AS component_id, MIN(r) = c.doc_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id
"""

CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS r(i))
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 CAST(coalesce(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(SUM(16 + length(role) + 3 * length(text) - length(replace(text, '\', '')) - length(replace(text, '<', ''))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_low = "lower(line)"
_furniture = " OR ".join(f"contains({_low}, '{x}')" for x in quality.BOILERPLATE)
QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
x AS (SELECT doc_id, i, ws[i:i + {_R.repeat_window - 1}] AS win FROM d, unnest(range(1, len(ws) - {_R.repeat_window - 2})) AS r(i)),
f AS (SELECT doc_id, win, list(i) AS places FROM x GROUP BY doc_id, win HAVING COUNT(*) > 1),
g AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {_R.repeat_window})) AS p FROM (SELECT doc_id, unnest(places) AS i FROM f)) GROUP BY doc_id),
l AS (SELECT doc_id, line, len(regexp_extract_all(line, {_WORD})) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
j AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT line) AS dup, SUM(CASE WHEN
  (regexp_matches(line, '{quality.MARKS}') AND (100 * len(regexp_extract_all(line, '{quality.SYMBOLS}')) > {_R.max_symbol_pct} * length(line) OR regexp_matches(line, '{quality.MENU}')))
  OR (length(line) <= {16 * _R.max_furniture_words} AND n <= {_R.max_furniture_words} AND (regexp_matches(line, '{quality.NAVIGATION}') OR {_furniture}))
  OR NOT regexp_matches(line, '[\p{{L}}\p{{N}}]') THEN n ELSE 0 END) AS lost FROM l WHERE n > 0 GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS BIGINT) AS n_symbols,
 CAST(coalesce(j.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(j.lost, 0) AS BIGINT) AS n_lost_words FROM d LEFT JOIN j ON j.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id),
v AS (SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_pct} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * n_lost_words <= {_R.max_lost_pct} * n_words AS kept FROM v
"""

TOP_K = r"""
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)]) AS BIGINT) AS score
 FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id, score FROM s WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 5
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEXICAL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}') AS ws FROM documents),
t AS (SELECT COUNT(*) FILTER (WHERE len(ws) > 0) AS n_docs, CAST(SUM(len(ws)) AS BIGINT) AS n_terms FROM d),
f AS (SELECT doc_id, n, term, COUNT(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * COUNT(*) + 1))) AS BIGINT) AS w FROM f, t GROUP BY term, n_docs),
q AS (SELECT item_id, term, COUNT(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(SUM(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
 FROM q JOIN w USING (term) JOIN f USING (term), t GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10
"""

ORACLES = {
    "op5_countmin_substrings": SUBSTRINGS,
    "op7_minhash_near_dedup": NEAR,
    "op8_prefix_targets": CHAT,
    "op10_line_first_quality": QUALITY,
    "op11_pivot_distance": TOP_K,
    "op12_term_pipeline": LEXICAL,
}
