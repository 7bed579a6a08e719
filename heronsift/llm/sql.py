"""DuckDB SQL for the operators that SQL can express."""

#: Targets by resharing in closed form: sources stop in the order of their
#: words per weight; the first prefix after which nobody else is above is right.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
dh AS (SELECT *, CAST(length(bin(greatest(size, 1))) - 1 AS BIGINT) AS h FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source),
s1 AS (SELECT *, CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS BIGINT) AS w FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY CAST(words AS DOUBLE) / w, source NULLS LAST) AS j,
              CAST(sum(words) OVER () AS BIGINT) AS total,
              CAST(coalesce(sum(3 * words) OVER (ORDER BY CAST(words AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped_before,
              CAST(sum(w) OVER (ORDER BY CAST(words AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_from
       FROM s1),
first_free AS (SELECT min(j) AS j FROM s2 WHERE CAST(w AS DOUBLE) * CAST(total - capped_before AS DOUBLE) / CAST(w_from AS DOUBLE) <= 3 * words),
level AS (SELECT s2.j, s2.total - s2.capped_before AS rest, s2.w_from AS free FROM s2, first_free f WHERE s2.j = f.j),
s3 AS (SELECT s2.source, s2.words,
              CASE WHEN level.j IS NULL OR s2.j < level.j THEN CAST(3 * words AS DOUBLE)
                   ELSE CAST(w AS DOUBLE) * CAST(rest AS DOUBLE) / CAST(free AS DOUBLE) END AS target
       FROM s2 LEFT JOIN level ON true),
s4 AS (SELECT *, CASE WHEN words > 0 THEN CAST(floor(target / words) AS BIGINT) ELSE 0 END AS base FROM s3),
s5 AS (SELECT *, CASE WHEN words > 0 THEN target - base * words ELSE 0.0 END AS missing FROM s4),
c0 AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS cw FROM dh GROUP BY source, h),
c1 AS (SELECT *, CAST(coalesce(sum(cw) OVER (PARTITION BY source ORDER BY h DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sure,
              CAST(sum((h + 1) * cw) OVER (PARTITION BY source ORDER BY h DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS load
       FROM c0),
c2 AS (SELECT c1.source, c1.h, CASE WHEN load <= 0 THEN 0.0 ELSE (missing - sure) / CAST(load AS DOUBLE) END AS c,
              load <= 0 OR (missing - sure) / CAST(load AS DOUBLE) * (h + 1) <= 1.0 AS fits
       FROM c1 JOIN s5 ON c1.source IS NOT DISTINCT FROM s5.source),
c3 AS (SELECT source, arg_max(c, h) AS c FROM c2 WHERE fits GROUP BY source),
p AS (SELECT dh.doc_id, dh.source, dh.size, dh.u, s5.words, s5.target, s5.base, s5.missing, least(1.0, c3.c * (dh.h + 1)) AS p
      FROM dh JOIN s5 ON dh.source IS NOT DISTINCT FROM s5.source LEFT JOIN c3 ON dh.source IS NOT DISTINCT FROM c3.source),
v AS (SELECT *, CASE WHEN p >= 1 THEN 0.0 WHEN p <= 0 THEN 1.0
                     ELSE ((u / (1.0 - u)) / (p / (1.0 - p))) / (1.0 + (u / (1.0 - u)) / (p / (1.0 - p))) END AS v FROM p),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v, u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY source, v, u) AS tied FROM v)
SELECT doc_id, size, words AS source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (base + CASE WHEN upto + upto - tied <= 2 * missing THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM r
"""

OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain FROM documents),
r AS (
  SELECT doc_id, sha256(plain) AS text_sha256, count(*) OVER (PARTITION BY plain) AS group_size,
         first_value(doc_id) OVER g AS keep_id, row_number() OVER g AS place
  FROM n WINDOW g AS (PARTITION BY plain ORDER BY length(t) DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""

OP8_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
listed(rule_host, rule_path, rule_verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (
  SELECT u.page_id, u.host, u.path, rule_host || rule_path AS rule, rule_verdict
  FROM u, listed WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS verdict FROM fits GROUP BY 1, 2, 3)
SELECT u.page_id, u.host, u.path, best.rule,
       coalesce(best.verdict, CASE
         WHEN regexp_matches(u.host || u.path, '/porn/(?:addiction|research)/') THEN 'allow'
         WHEN regexp_matches(u.host || u.path, '(?:^|[.\-])(?:ad|ads|adserver)[0-9]*\.|(?:^|[^a-z0-9])(?:casino|porn|xxx)(?:[^a-z0-9]|$)|/cgi-bin/|/wp-login\.php$|/(?:user/)?(?:login|signup)/?$') THEN 'block'
         ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best ON u.page_id = best.page_id AND u.host = best.host AND u.path = best.path
"""
