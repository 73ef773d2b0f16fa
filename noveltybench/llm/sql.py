"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE
    WHEN w IS NULL OR len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), classes AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)
), items AS (
  SELECT rep, n, unnest(s) AS x FROM classes
), common AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep GROUP BY ALL
), links AS (
  SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT rep AS node, rep AS low FROM classes
  UNION
  SELECT e.b, r.low FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.low < e.b
), comp AS (
  SELECT node, min(low) AS component FROM reach GROUP BY node
)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(comp.component, t.doc_id) AS component_id,
       t.doc_id = coalesce(comp.component, t.doc_id) AS kept
FROM sets t LEFT JOIN classes c ON list_sort(t.s) = c.s AND len(t.s) > 0 LEFT JOIN comp ON comp.node = c.rep
"""

OP4 = r"""
WITH lowered AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM lowered
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark
), spans AS (
  SELECT item, least(len(w), 10) AS n, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM spans
), lengths AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT d.doc_id, l.n, d.w, unnest(range(1, len(d.w) - l.n + 2)) AS i FROM docs d, lengths l WHERE len(d.w) >= l.n
), hits AS (
  SELECT p.doc_id, p.n, p.i, x.item FROM places p JOIN windows x ON x.n = p.n AND x.g = array_to_string(p.w[p.i : p.i + p.n - 1], ' ')
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(m.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""

OP5 = r"""
WITH cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), raw AS (
  SELECT doc_id AS doc, unnest(range(0, len(parts))) AS place, parts FROM cut
), trimmed AS (
  SELECT doc, place, trim(parts[place + 1], ' ') AS line FROM raw
), masked AS (
  SELECT doc, place, len(string_split(line, ' ')) AS n, string_split(regexp_replace(line, '[0-9]+', '<*>', 'g'), ' ') AS tokens
  FROM trimmed WHERE len(string_split(line, ' ')) >= 4
), placed AS (
  SELECT doc, place, n, CAST(n AS VARCHAR) || ' ' || array_to_string(tokens[1:3], ' ') AS leaf, array_to_string(tokens, ' ') AS form, tokens FROM masked
), forms AS (
  SELECT leaf, form, any_value(tokens) AS tokens, any_value(n) AS n, min({'d': doc, 'p': place}) AS first FROM placed GROUP BY leaf, form
), branches AS (
  SELECT leaf, form, first, b, tokens[4 + CAST(floor((n - 3) * ((b + 0.5) / 8)) AS INTEGER)] AS t1, tokens[4 + CAST(floor((n - 3) * (((3 * b + 1) % 8 + 0.5) / 8)) AS INTEGER)] AS t2
  FROM (SELECT *, unnest(range(0, 8)) AS b FROM forms)
), openings AS (
  SELECT leaf, b, t1, t2, arg_min(form, {'d': first.d, 'p': first.p}) AS template FROM branches GROUP BY ALL
), pairs AS (
  SELECT DISTINCT x.leaf, x.form, o.template FROM branches x JOIN openings o USING (leaf, b, t1, t2) WHERE x.form <> o.template
), follows AS (
  SELECT p.form, p.template FROM pairs p JOIN forms f ON f.leaf = p.leaf AND f.form = p.form JOIN forms t ON t.leaf = p.leaf AND t.form = p.template
  WHERE len(list_filter(range(1, f.n + 1), lambda i: f.tokens[i] = t.tokens[i])) >= greatest(ceil(0.7 * f.n), 3 + ceil((f.n - 3) / 2.0))
), templates AS (
  SELECT form, template FROM follows UNION SELECT form, form FROM forms
), marked AS (
  SELECT l.doc, l.place, t.template FROM placed l JOIN templates t USING (form)
), recurring AS (
  SELECT template, min(doc) AS first_doc FROM marked GROUP BY template HAVING count(DISTINCT doc) >= 2
), dropped AS (
  SELECT p.doc AS doc_id, list(DISTINCT p.place) AS places FROM marked p JOIN recurring r USING (template) WHERE p.doc > r.first_doc GROUP BY p.doc
), kept AS (
  SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(len(x.places), 0) AS n_dropped,
    coalesce(CASE WHEN x.places IS NULL THEN d.text
      ELSE array_to_string(list_transform(list_filter(range(0, len(string_split(d.text, chr(10)))), lambda i: NOT list_contains(x.places, i)), lambda i: string_split(d.text, chr(10))[i + 1]), chr(10)) END, '') AS t
  FROM documents d LEFT JOIN dropped x USING (doc_id)
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, CAST(length(t) AS BIGINT) AS n_chars_left, sha256(t) AS text_sha256 FROM kept
"""

OP6 = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ends AS (
  SELECT conv_id, coalesce(max(place) FILTER (role = 'assistant'), 0) AS last FROM turns GROUP BY conv_id
), replies AS (
  SELECT t.conv_id, t.text FROM turns t JOIN ends e ON e.conv_id = t.conv_id AND e.last = t.place
), rendered AS (
  SELECT t.conv_id, t.place, e.last, '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) AS s FROM turns t JOIN ends e USING (conv_id)
), asked AS (
  SELECT conv_id, string_agg(s, '' ORDER BY place) AS s, count(*) AS n FROM rendered WHERE last = 0 OR place < last GROUP BY conv_id
), closing AS (
  SELECT conv_id, string_agg(s, '' ORDER BY place) AS s, count(*) AS n FROM rendered WHERE last > 0 AND place > last GROUP BY conv_id
), pairs AS (
  SELECT e.conv_id, coalesce(a.s, '') AS s, coalesce(a.n, 0) AS n, coalesce(t.s, '') AS tail, coalesce(t.n, 0) AS n_tail, c.text IS NOT NULL AS replied,
         '<|assistant|>' || chr(10) || c.text || '<|end|>' || chr(10) AS own,
         CASE WHEN c.text IS NOT NULL THEN '<|assistant|>' || chr(10) || o.text || '<|end|>' || chr(10) END AS other
  FROM ends e LEFT JOIN asked a ON a.conv_id = e.conv_id LEFT JOIN closing t ON t.conv_id = e.conv_id
       LEFT JOIN replies c ON c.conv_id = e.conv_id LEFT JOIN replies o ON o.conv_id = xor(e.conv_id, 1)
), split AS (
  SELECT *, NOT replied OR coalesce(own = other, FALSE) AS same FROM pairs
)
SELECT conv_id, CAST(n + CASE WHEN same AND replied THEN 1 + n_tail ELSE 0 END AS BIGINT) AS n_prompt_turns, s || CASE WHEN same AND replied THEN own || tail ELSE '' END AS prompt,
       CASE WHEN same THEN '' ELSE own || tail END AS chosen, CASE WHEN same THEN '' ELSE coalesce(other, '') || tail END AS rejected,
       CASE WHEN same THEN '' ELSE '14-' || length(own) END AS chosen_spans,
       CASE WHEN same OR other IS NULL THEN '' ELSE '14-' || length(other) END AS rejected_spans
FROM split
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dup": OP1, "op4_decontamination": OP4, "op5_line_templates": OP5, "op6_preference_format": OP6}
