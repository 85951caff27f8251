"""DuckDB SQL for the queries that SQL expresses."""

from __future__ import annotations

from citegrid.llm import chat_format, decontamination, licenses, ngram_join, quality_rules, substring_dedup

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

W = substring_dedup.WINDOW
SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {W - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {W - 2})) AS i FROM d)),
o AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS owner FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {W})) AS p FROM o WHERE owner < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT x.doc_id, count(*) FILTER (WHERE c.p IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE c.p IS NULL), '') AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

S, P = ngram_join.SHINGLE, ngram_join.PERCENT
NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_transform({WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {S - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {S - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON b.k = a.k AND a.doc_id < b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= {P} * (any_value(p.n) + any_value(q.n) - count(*))),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id"""

G = quality_rules.WINDOW
QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {G - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {G - 2})) AS i FROM d)),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {G})) AS p FROM t WHERE n > 1) GROUP BY 1),
m AS (SELECT d.doc_id, text, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
b AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols * 100 > n_words * 30 OR n_dup_lines * 100 > len(lines) * 30
  OR word_chars < n_words * 2 OR word_chars > n_words * 20 OR length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) * 100 > word_chars * 50
  OR length(regexp_replace(text, '[^!]+', '', 'g')) * 100 > n_words * 50 OR NOT length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) * 100 > word_chars * 60
  OR len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) * 100 > len(lines) * 90
  OR len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09]*$'))) * 100 > len(lines) * 30) AS kept FROM b"""


def _templates() -> str:
    rows = sorted({(name, tuple(licenses.bigrams(licenses.normal_words(body)))) for name, body in licenses.TEMPLATES})
    return ", ".join(f"('{name}', [{', '.join(repr(g) for g in grams)}])" for name, grams in rows)


LICENSE_SCANS = f"""
WITH t(name, grams) AS (VALUES {_templates()}),
l AS (SELECT doc_id, list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '[.:;!?]+[\\x20\\x09-\\x0D]+'), regexp_split_to_array(text, '\\n[^A-Za-z0-9\\n]*\\n'), [text]) AS units FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
u AS (SELECT doc_id, string_split(unnest(list_distinct(list_transform(units, lambda x: trim(lower(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g')))))), ' ') AS w FROM l),
g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams, row_number() OVER () AS id FROM u WHERE len(w) > 1),
s AS (SELECT doc_id, id, name, len(list_intersect(g.grams, t.grams)) AS n, 2.0::DOUBLE * n / (len(g.grams) + len(t.grams)) AS dice FROM g JOIN t ON len(g.grams) BETWEEN len(t.grams) / 2 AND len(t.grams) * 2),
b AS (SELECT doc_id, id, min(struct_pack(fewer := -n, less := -dice, name := name)) AS best FROM s WHERE dice >= {licenses.THRESHOLD} GROUP BY 1, 2),
f AS (SELECT doc_id, min(best) AS best, count(*) AS n FROM b GROUP BY 1)
SELECT l.doc_id, f.best.name AS license, -f.best.less AS dice, coalesce(f.n, 0) AS n_notices FROM l LEFT JOIN f ON f.doc_id = l.doc_id"""

_TOKENS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)),
i AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS q FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark)),
a AS (SELECT doc_id, item_id, p - q AS begin, count(*) AS n_equal, any_value(n) AS n_words FROM d JOIN i ON i.word = d.word GROUP BY 1, 2, 3 HAVING count(*) * 100 >= any_value(n) * {decontamination.PERCENT})
SELECT doc_id, item_id, n_equal, CAST(n_words AS BIGINT) AS n_words, CAST(begin AS BIGINT) AS begin FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, begin) = 1"""

B, H = chat_format.BUDGET, chat_format.HISTORY
CHAT_FORMAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '{chat_format.CONTROL}'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS pos, len({WORDS}) + {chat_format.MARKS} AS tokens,
  24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')) AS chars FROM c),
s AS (SELECT *, coalesce(max(tokens) FILTER (pos = 1 AND role = 'system') OVER (PARTITION BY conv_id), 0) AS sys, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) AS stop FROM t),
b AS (SELECT *, stop - sys AS e, stop - sys - tokens AS b, greatest({B} - {H} - sys, {B} // 4) AS size FROM s),
y AS (SELECT *, 2 * (b // size) + CASE WHEN (e - 1) // size = b // size THEN 0 ELSE 1 END AS w FROM b WHERE pos > 1 OR sys = 0),
w AS (SELECT conv_id, w, min(b) AS at FROM y GROUP BY 1, 2),
h AS (SELECT y.conv_id, sum(y.chars) AS chars FROM y JOIN w ON w.conv_id = y.conv_id AND w.at BETWEEN y.e AND y.b + {H} GROUP BY 1),
n AS (SELECT conv_id, count(*) AS n FROM w GROUP BY 1),
k AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss,
  sum(chars) AS chars, coalesce(sum(chars) FILTER (pos = 1 AND sys > 0), 0) AS head FROM s GROUP BY 1)
SELECT k.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(k.chars + head * greatest(coalesce(n, 1) - 1, 0) + coalesce(h.chars, 0) AS BIGINT) AS formatted_chars FROM k LEFT JOIN n ON n.conv_id = k.conv_id LEFT JOIN h ON h.conv_id = k.conv_id"""

HARD_NEGATIVES = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b, p.score AS positive, s.b AS c, s.score AS negative, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS k
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT a AS anchor_id, b AS positive_id, CAST(k AS INTEGER) AS rank, c AS negative_id, positive AS positive_score, negative AS negative_score FROM n WHERE k <= 5"""
