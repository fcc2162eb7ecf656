"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .chat import CLOSE, ESCAPES, NAME_END, OPEN, PART
from .licenses import BETWEEN, TEMPLATES
from .quality import MARKS, SEPARATORS, STOCK, SYMBOLS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(column: str, rules) -> str:
    for plain, coded in rules:
        column = f"replace({column}, {quoted(plain)}, {quoted(coded)})"
    return column


_NORMAL = "trim(regexp_replace(lower(coalesce({}, '')), " + quoted(BETWEEN).replace("{", "{{").replace("}", "}}") + ", ' ', 'g'))"
_RUN = r"'[^\x20\x09-\x0D]+'"

LICENSES = f"""
WITH given(license, body) AS (VALUES {", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in TEMPLATES.items())}),
tw AS (SELECT license, string_split({_NORMAL.format("body")}, ' ') AS w FROM given),
ts AS (SELECT DISTINCT license, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM tw)),
dw AS (SELECT doc_id, string_split({_NORMAL.format("text")}, ' ') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
n AS (SELECT license, count(*) AS n FROM ts GROUP BY 1)
SELECT doc_id, license, round(count(*) / any_value(n), 6) AS containment
FROM ds JOIN ts USING (s) JOIN n USING (license) GROUP BY 1, 2 HAVING count(*) / any_value(n) >= 0.8
"""

QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, {_RUN}) AS w, string_split(x, chr(10)) AS l FROM t),
judged AS (SELECT *, list_filter(l, lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS full_lines,
  list_filter(l, lambda s: NOT regexp_matches(s, '[^\x20\x09-\x0D]') OR NOT (
    len(regexp_extract_all(s, {quoted(MARKS)})) > 0.3 * greatest(len(regexp_extract_all(s, {_RUN})), 1)
    OR len(regexp_extract_all(s, {quoted(SEPARATORS)})) >= 2
    OR len(regexp_extract_all(s, {quoted(STOCK)})) * 30 >= greatest(len(regexp_extract_all(s, {_RUN})), 1))) AS kept_lines FROM w),
places AS (SELECT doc_id, array_to_string(w[i:i+4], ' ') AS s, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM places) WHERE n > 1),
held AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(0, 5)) AS p FROM twice) GROUP BY 1),
counts AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(x, {quoted(SYMBOLS)}))::BIGINT AS n_symbols,
  (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  coalesce(length(regexp_replace(array_to_string(kept_lines, ''), '[\x20\x09-\x0D]+', '', 'g')), 0)::BIGINT AS kept_chars
  FROM judged LEFT JOIN held USING (doc_id)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND kept_chars > 0 AND kept_chars >= 0.5 * word_chars AS kept, kept_chars FROM failed
"""

CHAT = f"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), {quoted(chr(92) + "### Assistant: </turn> ok")}),
placed AS (SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS goes_on FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escaped("text", ESCAPES[:3])}) + CASE WHEN goes_on THEN {len(PART)} ELSE {len(OPEN + NAME_END + CLOSE)} + length({_escaped("role", ESCAPES)}) END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = f"""
WITH d AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
totals AS (SELECT count(*) AS cn, sum(n)::BIGINT AS cl FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(cn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
gains AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * cn) // cl)) AS gain FROM tf JOIN sizes USING (doc_id), totals),
scored AS (SELECT item_id, doc_id, sum(times * w * gain)::BIGINT AS score FROM asked JOIN weights USING (term) JOIN gains USING (term) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

ORACLES = {"op1_license_scan": LICENSES, "op9_quality_rules": QUALITY, "op10_chat_format": CHAT, "op11_lexical_search": LEXICAL, "op12_exact_top_k": TOP_K}
