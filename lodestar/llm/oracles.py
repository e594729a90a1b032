"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
w AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM d),
g AS (SELECT r, p, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g,
             count(*) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM w),
t AS (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM g WHERE n = 8),
c AS (SELECT r, count(DISTINCT p + o.k) AS covered FROM t, (SELECT unnest(range(8)) AS k) o WHERE c > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT d.r, doc_id, source, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered, 0) AS n_repeat_words
  FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN u ON u.r = d.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(f) / sum(n) AS mean, sum(f * f / n) - sum(f) * (sum(f) / sum(n)) AS spread, sum(n * n) / sum(n) AS nn FROM h),
q AS (SELECT mean, CASE WHEN mean * (1 - mean) > 0 AND n - nn - (k - 1) > 0 THEN (spread - mean * (1 - mean) * (k - 1)) / (mean * (1 - mean) * (n - nn - (k - 1))) ELSE 0 END AS alike FROM p),
k AS (SELECT mean, CASE WHEN alike > 0 THEN least(greatest(1 / alike - 1, 1), 1e6) ELSE 1e6 END::DOUBLE AS weight FROM q),
y AS (SELECT source, n + weight AS total, (f + mean * weight) / (n + weight) AS rate FROM h, k),
x AS (SELECT source FROM y WHERE rate - 1.645::DOUBLE * sqrt(rate * (1 - rate) / (total + 1)) > 0.5)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND x.source IS NULL AS kept
FROM b LEFT JOIN x ON x.source = b.source
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS total FROM d GROUP BY source),
w AS (SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT) AS weight FROM s),
l AS (SELECT *, 3 * total AS cap, 3 * total / weight AS level,
             CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS key FROM w),
a AS (SELECT *, (SELECT sum(total) FROM l) - coalesce(sum(cap) OVER (ORDER BY level, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY level, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shared FROM l),
f AS (SELECT * FROM a WHERE rest / shared <= level ORDER BY level, key LIMIT 1),
t AS (SELECT a.source, a.total, CASE WHEN f.key IS NULL OR (a.level, a.key) < (f.level, f.key) THEN a.cap
             ELSE least(a.cap, a.weight * f.rest / f.shared) END AS target FROM a LEFT JOIN f ON true),
c AS (SELECT d.*, row_number() OVER () AS r, t.total::BIGINT AS source_size, t.target, CASE WHEN d.source IS NULL THEN '-' ELSE '+' || d.source END AS key,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
e AS (SELECT *, pass * source_size + start AS begins, pass * source_size + start + size AS ends, floor(target)::BIGINT AS line
      FROM c, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0 AND pass * source_size + start < target),
k AS (SELECT r, key, pass, start, ends / target AS finish, size AS words FROM e WHERE ends <= target
      UNION ALL SELECT r, key, pass, start, 1.0, greatest(line - begins, 0) FROM e WHERE ends > target
      UNION ALL SELECT r, key, pass, start, ends / target, ends - greatest(line, begins) FROM e WHERE ends > target),
o AS (SELECT r, words, (SELECT sum(size) FROM c) - coalesce(sum(words) OVER (ORDER BY finish, key, pass, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fits FROM k WHERE words > 0),
g AS (SELECT r, sum(greatest(0, least(words, fits)))::BIGINT AS taken FROM o GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM c LEFT JOIN g ON g.r = c.r
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT html, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN g ON g.html = p.html
"""

OP4 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
g AS (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
s AS MATERIALIZED (SELECT DISTINCT r, g FROM g),
n AS MATERIALIZED (SELECT d.r, doc_id, count(g) AS n FROM d LEFT JOIN s ON s.r = d.r GROUP BY d.r, doc_id),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
l AS MATERIALIZED (SELECT o.a, o.b FROM o JOIN n x ON x.r = o.a JOIN n y ON y.r = o.b WHERE 100 * o.o >= 75 * (x.n + y.n - o.o)),
c AS (SELECT r AS a, r AS b FROM n UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(m.doc_id) AS component_id
FROM n JOIN c ON c.a = n.r JOIN n m ON m.r = c.b GROUP BY n.r, n.doc_id, n.n
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, s.s AS size, unnest(list_transform(range(1, len(w) - s.s + 2), lambda i: array_to_string(w[i:i + s.s - 1], ' '))) AS g FROM w, (SELECT unnest([1, 2, 3]) AS s) s WHERE len(w) >= s.s),
f AS MATERIALIZED (SELECT lang, size, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
k AS (SELECT f.lang, f.size, f.g, f.f AS a, k.k, string_split(f.g, ' ') AS w FROM f, (SELECT unnest([1, 2]) AS k) k WHERE k.k < f.size),
c AS (SELECT k.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.g = array_to_string(k.w[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.g = array_to_string(k.w[k.k + 1:k.size], ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
i AS (SELECT lang, s, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS s FROM b WHERE size = 3) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.s = b.g WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT o.lang, rank, g AS phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""

ORACLES = {"op11_collocations": OP11, "op4_jaccard_join": OP4, "op5_warc": OP5, "op3_quality_rules": OP3, "op9_mixing": OP9}
