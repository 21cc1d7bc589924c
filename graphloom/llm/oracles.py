"""SQL for an independent engine: near-duplicates, and quality rules with their references."""

from __future__ import annotations

from graphloom.llm.quality_rules import COMMON, DECIMALS, FLOOR, LEAST_CHARS_CLASS, LEAST_WORDS, LEAST_WORDS_COMMON, MOST_CLASS, MOST_COMMON, REPEAT_PERCENT, SYMBOLS

WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
h AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END) AS s FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inside FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inside >= 85 * (x.n + y.n - inside)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_listed = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words)}]" for lang, words in COMMON.items())
_known = ", ".join(f"'{lang}'" for lang in COMMON)

OP5_SQL = f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
d AS MATERIALIZED (SELECT doc_id, w, CASE WHEN lang IN ({_known}) THEN lang ELSE '' END AS g, CASE lang {_listed} END AS common, length(t) AS chars, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
  length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS upper, length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(t, '[^\\p{{N}}]+', '', 'g')) AS numbers FROM t),
v AS (SELECT doc_id, unnest(range(1, greatest(1, len(w) - 3))) AS k, w FROM d),
x AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, array_to_string(w[k:k + 4], ' ')) AS n FROM v),
y AS (SELECT doc_id, count(DISTINCT k + j) AS n_repeat_words FROM x, range(0, 5) AS z(j) WHERE n > 1 GROUP BY doc_id),
b AS MATERIALIZED (SELECT d.*, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, list_transform(common, lambda c: len(list_filter(w, lambda q: q = c))) AS found FROM d LEFT JOIN y ON y.doc_id = d.doc_id),
s AS (SELECT doc_id, g, n_words, 'class' AS kind, list_transform([upper, letters - upper, numbers, chars - word_chars, n_symbols, word_chars - letters - numbers - n_symbols], lambda c: c::DOUBLE / chars) AS shares FROM b WHERE chars >= {LEAST_CHARS_CLASS}
  UNION ALL SELECT doc_id, g, n_words, 'common', list_transform(list_append(found, n_words - list_sum(found)), lambda c: c::DOUBLE / n_words) FROM b WHERE n_words >= {LEAST_WORDS_COMMON} AND common IS NOT NULL),
u AS MATERIALIZED (SELECT doc_id, g, kind, n_words, unnest(shares) AS share, generate_subscripts(shares, 1) AS k FROM s),
m AS (SELECT g, kind, k, greatest(quantile_cont(round(share, {DECIMALS}), 0.5), {FLOOR}) AS m FROM u WHERE n_words >= {LEAST_WORDS} GROUP BY g, kind, k),
r AS (SELECT g, kind, k, m / sum(m) OVER (PARTITION BY g, kind) AS q FROM m),
j AS (SELECT doc_id, kind, sqrt(greatest(sum(CASE WHEN share > 0 THEN share * log2(2 * share / (share + q)) ELSE 0 END + q * log2(2 * q / (share + q))) / 2, 0)) AS js FROM u JOIN r USING (g, kind, k) GROUP BY doc_id, kind),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(c.js, 0) <= {MOST_CLASS} AND coalesce(o.js, 0) <= {MOST_COMMON} AS kept
FROM f LEFT JOIN j c ON c.doc_id = f.doc_id AND c.kind = 'class' LEFT JOIN j o ON o.doc_id = f.doc_id AND o.kind = 'common'
"""
