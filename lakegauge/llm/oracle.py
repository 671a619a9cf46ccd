"""DuckDB twins of the corpus queries that SQL can express. They state the result, not the method."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, u.i AS pos, u.line, lower(trim(u.line, chr(32) || chr(9) || chr(13))) AS norm
  FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'line': x})) AS u FROM documents)
),
firsts AS (
  SELECT norm, length(norm) AS n, min((doc_id, pos)) AS first, row_number() OVER (ORDER BY norm) AS id
  FROM lines WHERE length(norm) >= 1 GROUP BY norm
),
halves AS (
  SELECT id, m, h, s FROM (
    SELECT id, n, norm, unnest([n, n - 1]) AS m FROM firsts WHERE n >= 20
  ), LATERAL (SELECT unnest([0, 1]) AS s), LATERAL (
    SELECT CASE s WHEN 0 THEN left(norm, m // 2) ELSE right(norm, m - m // 2) END AS h
  )
),
pairs AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM halves a JOIN halves b USING (m, h, s) WHERE a.id <> b.id
),
near AS (
  SELECT DISTINCT x.id FROM pairs JOIN firsts x ON x.id = a JOIN firsts y ON y.id = b
  WHERE y.first < x.first AND CASE
    WHEN x.n = y.n THEN list_bool_or(list_transform(range(0, x.n), lambda i: left(x.norm, i) = left(y.norm, i) AND substr(x.norm, i + 2) = substr(y.norm, i + 2)))
    WHEN x.n = y.n + 1 THEN list_bool_or(list_transform(range(0, x.n), lambda i: left(x.norm, i) = left(y.norm, i) AND substr(x.norm, i + 2) = substr(y.norm, i + 1)))
    WHEN y.n = x.n + 1 THEN list_bool_or(list_transform(range(0, y.n), lambda i: left(y.norm, i) = left(x.norm, i) AND substr(y.norm, i + 2) = substr(x.norm, i + 1)))
    ELSE false END
),
judged AS (
  SELECT l.doc_id, l.pos, l.line, f.norm IS NOT NULL AS counted,
    f.norm IS NULL OR (f.first = (l.doc_id, l.pos) AND f.id NOT IN (SELECT id FROM near)) AS stays
  FROM lines l LEFT JOIN firsts f ON f.norm = l.norm
)
SELECT doc_id, count(*)::INTEGER AS n_lines, count(*) FILTER (counted)::INTEGER AS n_counted, count(*) FILTER (NOT stays)::INTEGER AS n_removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS text_md5
FROM judged GROUP BY doc_id
"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, v.i AS i, v.k AS k FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 11)), lambda i: {{'i': i, 'k': array_to_string(w[i:i + 12], ' ')}})) AS v FROM d
  )
),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM windows JOIN firsts USING (k) WHERE doc_id > first
),
words AS (SELECT doc_id, unnest(list_transform(w, lambda x, j: {{'x': x, 'j': j}})) AS u FROM d),
kept AS (
  SELECT words.doc_id, string_agg(u.x, ' ' ORDER BY u.j) AS body, count(*) AS n
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = u.j WHERE gone.j IS NULL GROUP BY words.doc_id
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d
),
each AS (SELECT doc_id, unnest(s) AS x FROM sets),
often AS (SELECT x FROM each GROUP BY x HAVING count(*) > 1),
shared AS (SELECT doc_id, x FROM each WHERE x IN (SELECT x FROM often)),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shared a JOIN shared b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM both_ways
  UNION
  SELECT reached.doc_id, both_ways.b FROM reached JOIN both_ways ON both_ways.a = reached.other
),
least AS (SELECT doc_id, min(other) AS component FROM reached GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sets LEFT JOIN least USING (doc_id)
"""

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM benchmark WHERE text IS NOT NULL),
item_shingles AS (
  SELECT item_id, len(w) AS n, u.j AS j, u.x AS x FROM (
    SELECT item_id, w, unnest(list_transform(range(0, len(w) - 4), lambda j: {'j': j, 'x': array_to_string(w[j + 1:j + 5], ' ')})) AS u FROM b WHERE len(w) >= 5)
),
doc_shingles AS (
  SELECT doc_id, total, u.j AS p, u.x AS x FROM (
    SELECT doc_id, len(w) AS total, unnest(list_transform(range(0, len(w) - 4), lambda j: {'j': j, 'x': array_to_string(w[j + 1:j + 5], ' ')})) AS u FROM d WHERE len(w) >= 5)
),
windows AS (
  SELECT DISTINCT doc_id, item_id, n, p - j AS start FROM doc_shingles JOIN item_shingles USING (x) WHERE p >= j AND p - j + n <= total
),
in_window AS (
  SELECT windows.doc_id, item_id, n, start, x, count(*) AS c FROM windows JOIN doc_shingles s ON s.doc_id = windows.doc_id AND s.p BETWEEN start AND start + n - 5
  GROUP BY ALL
),
in_item AS (SELECT item_id, x, count(*) AS c FROM item_shingles GROUP BY ALL),
found AS (
  SELECT doc_id, item_id, n, start, sum(least(in_window.c, in_item.c)) AS common FROM in_window JOIN in_item USING (item_id, x) GROUP BY ALL
)
SELECT doc_id, item_id, start, n::BIGINT AS n_words, common / (2 * (n - 4) - common) AS similarity
FROM found WHERE common / (2 * (n - 4) - common) >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""

MIXING = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    list_extract([3.0, 1.0, 2.0]::DOUBLE[], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight
  FROM sized GROUP BY source
),
-- Sources stop in the order of words by weight: with the first k stopped, the others share what is left.
stops AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS budget, 2.0 * source_size / weight AS reach,
    coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
    sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM totals
),
level AS (SELECT arg_min((budget - given) / open, reach) AS level FROM stops WHERE reach >= (budget - given) / open),
targets AS (SELECT source, source_size, least(weight * level, 2.0 * source_size) AS target FROM totals, level),
rated AS (
  SELECT doc_id, size, source_size, target, coalesce(target / nullif(source_size, 0)::DOUBLE, 0) AS rate,
    ('0x' || left(md5('11 ' || doc_id), 13))::BIGINT / 4503599627370496.0::DOUBLE AS drawn
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM rated
"""

NEGATIVES = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""
