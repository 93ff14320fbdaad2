"""DuckDB SQL of the queries that SQL can say."""

_LOWERED = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_BLANK = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED.format("text")}, {_PLAIN}) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWERED.format("text")}, {_PLAIN}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, len(w[i:i + 12]) AS n, w[i:i + 12] AS terms
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS terms
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.terms = bw.terms),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED.format("text")}, {_BLANK}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS v, doc_id AS m FROM d UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.m) AS component_id
FROM d JOIN r ON r.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

SOURCE_MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_BLANK})) AS size, md5(coalesce(text, '')) AS digest FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, digest) - 1 AS copy FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM s),
w AS (SELECT *, number % 3 + 1 AS weight FROM r),
l AS (SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER up, 0) AS BIGINT) AS rest, CAST(sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS BIGINT) AS shares
      FROM w WINDOW up AS (ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT rest, shares FROM l WHERE 3 * source_size / weight >= rest / shares ORDER BY source_size / weight, number LIMIT 1),
t AS (SELECT source, number, source_size, least(weight * (f.rest / f.shares), CAST(3 * source_size AS DOUBLE)) AS target FROM w, f),
b AS (SELECT c.doc_id, c.source, c.size, c.digest, c.copy, t.number, t.source_size, CAST(round(t.target) AS BIGINT) AS goal, unnest(range(0, c.size, 512)) AS first
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, least(512, size - first) AS words, md5(concat_ws(':', '12', coalesce(CAST(doc_id AS VARCHAR), ''), digest, CAST(copy AS VARCHAR), CAST(first // 512 AS VARCHAR))) AS key FROM b),
p AS (SELECT *, CAST(sum(words) OVER (PARTITION BY number ORDER BY key, doc_id, copy, first) - words AS BIGINT) AS before FROM k),
g AS (SELECT doc_id, source, size, digest, copy, CAST(sum(greatest(0, least(words, goal - before)) + greatest(0, least(words, goal - before - source_size)) + greatest(0, least(words, goal - before - 2 * source_size))) AS BIGINT) AS taken
      FROM p GROUP BY ALL)
SELECT c.doc_id, c.size, t.source_size, t.target, coalesce(g.taken, 0) AS taken
FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM c.doc_id AND g.source IS NOT DISTINCT FROM c.source AND g.size = c.size AND g.digest = c.digest AND g.copy = c.copy
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) for k in [0, 1, 2, 3]] AS h FROM d),
c AS (SELECT doc_id, t, w, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(list_slice(w, 1, a), ''), '') AS x, coalesce(array_to_string(list_slice(w, a + 1, b), ''), '') AS y, coalesce(array_to_string(list_slice(w, b + 1, n), ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
