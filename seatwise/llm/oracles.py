"""DuckDB SQL of the llm queries that SQL can express."""

from __future__ import annotations

from seatwise.llm.licenses import NOTICES

_COMPONENT = """reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)"""

OP2 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' (' || len(w) || ')'] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x AS a, y AS b FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENT}
SELECT a AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM component LEFT JOIN sizes ON doc_id = a
"""

OP3 = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
nodes AS (SELECT id FROM v), {_COMPONENT}
SELECT c.a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = c.a)::BIGINT AS n_links, component_id, c.a = component_id AS kept FROM component c
"""

OP5 = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h FROM documents),
k AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
"""

OP6 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
    sum(24 + length(role) + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'))) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars FROM g
"""

OP8 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM k
"""

_TEMPLATES = ", ".join(f"({k + 1}, '{name}', '{text}')" for k, (name, text) in enumerate(NOTICES))

OP9 = f"""
WITH template(template_id, license, text) AS (VALUES {_TEMPLATES}),
tw AS (SELECT template_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM template),
ts AS (SELECT DISTINCT template_id, array_to_string(w[i:i + 4], ' ') AS s FROM tw, unnest(range(1, len(w) - 3)) r(i)),
tn AS (SELECT template_id, count(*) AS n_template FROM ts GROUP BY template_id),
half AS (SELECT greatest(16, max(n_template)) AS h FROM tn),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s FROM dw, unnest(range(1, len(w) - 3)) r(i)),
hit AS (SELECT doc_id, pos, s FROM ds WHERE s IN (SELECT s FROM ts)),
win AS (
  SELECT doc_id, pos // h AS window_no, s, pos FROM hit, half
  UNION ALL SELECT doc_id, pos // h - 1, s, pos FROM hit, half WHERE pos >= h),
m AS (
  SELECT doc_id, template_id, window_no, count(DISTINCT win.s) AS n_matched, min(pos) AS first_pos
  FROM win JOIN ts ON win.s = ts.s GROUP BY ALL),
best AS (
  SELECT doc_id, template_id, n_matched, first_pos, n_template,
    row_number() OVER (PARTITION BY doc_id, template_id ORDER BY n_matched DESC, first_pos) AS k
  FROM m JOIN tn USING (template_id) WHERE n_matched * 100 >= n_template * 80)
SELECT doc_id, template_id::BIGINT AS template_id, license, n_matched, n_template, n_matched / n_template AS containment, first_pos::BIGINT AS first_pos
FROM best JOIN template USING (template_id) WHERE k = 1
"""

OP11 = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (
  SELECT r, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) u(t)),
keep AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
lang_size AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM keep GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
seen AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN keep USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, source, coalesce(sum(seen.n), 0)::HUGEINT AS n FROM grp LEFT JOIN seen USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n, 1 + (1000000000 * (coalesce(s.n, 0) + 1)) // (g.n + l.v) AS p,
    1 + (1000000000 * (k.n + 1)) // (l.n + l.v) AS q
  FROM size g JOIN keep k USING (lang) JOIN lang_size l USING (lang) LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

OP12 = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS tab),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM documents, crc),
place AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
plan AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM place),
word AS (SELECT doc_id, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS x FROM plan, unnest(range(n)) r(i)),
eq AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM word l JOIN word r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i),
isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM eq),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM isle GROUP BY doc_id, q, k HAVING count(*) >= q),
run AS (SELECT doc_id, s, len, min(q) AS q FROM stretch GROUP BY doc_id, s, len HAVING len >= 6 AND len >= 4 * min(q)),
said AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY doc_id),
best AS (
  SELECT r.* FROM run r WHERE NOT EXISTS (
    SELECT 1 FROM run b WHERE b.doc_id = r.doc_id AND (b.len * r.q > r.len * b.q OR (b.len * r.q = r.len * b.q AND (b.s < r.s OR (b.s = r.s AND b.q < r.q)))))),
gone AS (SELECT DISTINCT doc_id, i FROM run, unnest(range(s + q, s + len)) u(i)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s AS start, b.len AS length, b.q AS period, 1000 * b.len // b.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN said USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
