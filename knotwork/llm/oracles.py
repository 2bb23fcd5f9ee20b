"""SQL, as DuckDB has it, for the operators that SQL can express."""

#: Exact near-duplicates: all pairs that share a shingle, then reachability.
OP4 = r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id,
         CASE WHEN len(w) = 0 THEN []
              WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
shingles AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (
  SELECT a, b FROM shared WHERE 100 * k >= 75 * (na + nb - k)
  UNION ALL SELECT b, a FROM shared WHERE 100 * k >= 75 * (na + nb - k)),
reach AS (
  SELECT doc_id AS origin, doc_id AS node FROM sized
  UNION
  SELECT r.origin, l.b FROM reach r JOIN links l ON r.node = l.a)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sized s JOIN (SELECT origin, min(node) AS component_id FROM reach GROUP BY origin) r ON s.doc_id = r.origin
"""

#: Brute force over all pairs of a query and a candidate.
OP2 = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS (SELECT vec_id, min(v) AS v FROM usable WHERE vec_id % 100 = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM asked q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

#: Types and targets by payload, straight from the pages.
OP1 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM original AND g.digest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest
"""

#: Quotes by their text, parents by a scan of earlier turns, threads by recursion.
OP7 = r"""
WITH RECURSIVE
m AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text, string_split_regex(text, '\r\n|\n|\r') AS lines FROM conversations),
l AS (
  SELECT conv_id, turn, unnest(string_split_regex(text, '\r\n|\n|\r')) AS line
  FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL),
p AS (
  SELECT conv_id, turn,
         length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+[ \t]?'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '')), '[ \t]+', ' ', 'g')) AS passage
  FROM l),
g AS (SELECT conv_id, turn, level, passage, count(*) AS n FROM p WHERE passage <> '' GROUP BY ALL),
f AS (
  SELECT q.conv_id, q.turn, q.level, q.passage, any_value(q.n) AS n, max(o.turn) AS found
  FROM g q LEFT JOIN g o ON o.level = 0 AND o.conv_id = q.conv_id AND o.passage = q.passage AND o.turn < q.turn
  WHERE q.level > 0 GROUP BY q.conv_id, q.turn, q.level, q.passage),
votes AS (SELECT conv_id, turn, found, sum(n) AS n FROM f WHERE level = 1 AND found IS NOT NULL GROUP BY ALL),
best AS (
  SELECT conv_id, turn, found AS parent_turn FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, found DESC) = 1),
counts AS (
  SELECT conv_id, turn, CAST(sum(n) AS BIGINT) AS n_quoted, CAST(coalesce(sum(n) FILTER (WHERE found IS NOT NULL), 0) AS BIGINT) AS n_linked
  FROM f GROUP BY ALL),
walk AS (
  SELECT conv_id, turn, parent_turn AS thread_turn, 1 AS depth FROM best
  UNION ALL
  SELECT w.conv_id, w.turn, b.parent_turn, w.depth + 1 FROM walk w JOIN best b ON w.conv_id = b.conv_id AND w.thread_turn = b.turn),
roots AS (SELECT conv_id, turn, min(thread_turn) AS thread_turn, max(depth) AS depth FROM walk GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role,
       regexp_replace(array_to_string(list_filter(m.lines, lambda x, i: NOT regexp_matches(x, '^(?:[ \t]*>)+[ \t]?')
         AND NOT (regexp_matches(x, '^[ \t]*(?:On|Le|Am|El)[ \t].*(?:wrote|écrit|schrieb.*|escribió)[ \t\x{a0}]*:[ \t]*$') AND coalesce(regexp_matches(m.lines[i + 1], '^(?:[ \t]*>)+[ \t]?'), false))), chr(10)), '\A[ \t\n]+|[ \t\n]+\z', '', 'g') AS body,
       b.parent_turn, coalesce(r.thread_turn, m.turn) AS thread_turn, CAST(coalesce(r.depth, 0) AS BIGINT) AS depth,
       coalesce(c.n_quoted, 0) AS n_quoted, coalesce(c.n_linked, 0) AS n_linked
FROM m
LEFT JOIN best b ON m.conv_id = b.conv_id AND m.turn = b.turn
LEFT JOIN roots r ON m.conv_id = r.conv_id AND m.turn = r.turn
LEFT JOIN counts c ON m.conv_id = c.conv_id AND m.turn = c.turn
"""
