"""The same results in DuckDB's SQL, where SQL can express them."""

MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS hash
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ordinal
  FROM docs GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][CAST(ordinal % 3 AS INT) + 1] AS weight, 3 * source_size AS cap,
    (SELECT sum(size) FROM docs) AS total
  FROM sources),
-- with sources in the order of cap by weight, the capped ones come first
steps AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER before, 0) AS DOUBLE) / CAST(sum(weight) OVER after AS DOUBLE) AS unit,
    CAST(cap AS DOUBLE) / weight AS reach
  FROM weighted
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (ORDER BY CAST(cap AS DOUBLE) / weight, ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
unit AS (SELECT unit AS u FROM steps WHERE unit * weight <= cap ORDER BY reach, ordinal LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN weight * u > cap THEN CAST(cap AS DOUBLE) ELSE weight * u END AS target
  FROM weighted, unit),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS full_takes
  FROM targets),
sums AS (
  SELECT d.source, d.hash, p.target - p.full_takes * p.source_size AS budget, CAST(sum(d.size) AS DOUBLE) AS n
  FROM docs d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
  WHERE d.size > 0 AND p.full_takes < 3 GROUP BY ALL),
running AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY hash) AS upto FROM sums),
ends AS (
  SELECT source, CASE WHEN upto - budget < budget - (upto - n) THEN hash ELSE hash - 1 END AS threshold
  FROM running WHERE upto > budget AND upto - n <= budget)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, p.source_size, p.target,
  CAST(d.size * (p.full_takes + CASE WHEN d.hash <= e.threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM docs d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN ends e ON d.source IS NOT DISTINCT FROM e.source
"""

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    CAST(floor(coalesce(turn, 0) / 256) AS BIGINT) AS block
  FROM conversations WHERE conv_id IS NOT NULL),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
shown AS (
  SELECT t.conv_id, t.block, p.perspective, t.turn, t.role, t.text, t.role = p.perspective AS own,
    CASE WHEN t.role = p.perspective THEN '<|assistant|>' || chr(10)
      WHEN t.role = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user name=' || regexp_replace(t.role, '[^\p{L}\p{N}_.-]', '_', 'g') || '|>' || chr(10) END AS head,
    replace(replace(t.text, '<|', '<\|'), '|>', '|\>') || '<|end|>' || chr(10) AS body
  FROM turns t JOIN people p ON t.conv_id = p.conv_id),
placed AS (
  SELECT *, row_number() OVER w AS k, sum(length(head) + length(body)) OVER w AS upto FROM shown
  WINDOW w AS (PARTITION BY conv_id, block, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, block, perspective, CAST(count(*) AS INT) AS n_turns,
  string_agg(head || body, '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(upto - length(body) AS BIGINT) || '-' || CAST(upto AS BIGINT), ',' ORDER BY k) FILTER (own), '') AS masks
FROM placed GROUP BY conv_id, block, perspective
"""

EXACT_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS nr, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, nr) = 1 AS kept, sha256(text) AS text_sha256
FROM docs WINDOW w AS (PARTITION BY text)
"""

AUDIT_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
found AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM counts GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * l.v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (k.n + 2) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
  FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
