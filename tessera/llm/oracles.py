"""DuckDB SQL for the queries of this package that SQL can express, over whole tables."""

from __future__ import annotations

QUALITY_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, 'null') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), words AS (
  SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w
), grams AS (
  SELECT r, i, x AS a, lead(x) OVER p AS b, lead(x, 2) OVER p AS c FROM words WINDOW p AS (PARTITION BY r ORDER BY i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM grams WHERE c IS NOT NULL) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r
), lines AS (
  SELECT r, host, unnest(ls) AS x FROM w
), normal AS (
  SELECT r, host, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS x FROM lines
), hosts AS (
  SELECT host, count(*) AS n FROM d GROUP BY host
), often AS (
  SELECT host, x FROM (SELECT host, x, count(DISTINCT r) AS docs FROM normal GROUP BY host, x) JOIN hosts USING (host)
  WHERE docs > 10 AND docs > n * 0.02
), lost AS (
  SELECT r, sum(len(x) - len(replace(x, ' ', '')) + 1) AS n FROM normal JOIN often USING (host, x) GROUP BY r
), base AS (
  SELECT w.r, doc_id, len(ws) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS boilerplate_words
  FROM w LEFT JOIN covered ON covered.r = w.r LEFT JOIN lost ON lost.r = w.r
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, boilerplate_words,
       NOT base_failed AND n_words - boilerplate_words >= n_words * 0.5 AS kept
FROM failed
"""

SHARDING = r"""
WITH RECURSIVE crc AS (
  SELECT i, 0 AS k, i AS c FROM range(256) AS t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8
), d AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS s, coalesce(text, '') AS x FROM documents
), m AS (
  SELECT doc_id, s, octet_length(encode(x)) + 16 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(rtrim(regexp_replace(hex(encode(x)), '(..)', '\1,', 'g'), ','), ','),
           lambda b: CASE WHEN b = '' THEN -1 ELSE ('0x' || b)::BIGINT END)),
           lambda a, b: CASE WHEN b < 0 THEN a ELSE xor(a >> 8, tab.t[xor(a & 255, b) + 1]) END), 4294967295::BIGINT) AS text_crc32
  FROM d, tab
), i AS (
  SELECT *, md5('shuffle-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size || ':' || text_crc32) AS h FROM m
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY s ORDER BY h, doc_id, size, text_crc32) - 0.5::DOUBLE)
            / count(*) OVER (PARTITION BY s) AS place FROM i
), p AS (
  SELECT *, row_number() OVER (ORDER BY place, s, h, doc_id, size, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM r
), c AS (
  SELECT *, pos * 40 // n AS g FROM p
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(g AS INTEGER) AS shard,
       CAST(pos - (g * n + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM c
"""

LINE_DEDUP = r"""
WITH d AS (
  -- without a doc_id: one document, smaller than any other
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS id,
         string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, doc_id, id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM d
), k AS (
  SELECT *, translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), hot AS (
  SELECT key, max(id) AS keeper FROM k WHERE len(key) >= 40 GROUP BY key HAVING count(DISTINCT id) >= 5
), f AS (
  SELECT k.*, hot.key IS NOT NULL AND k.id <> hot.keeper AS gone FROM k LEFT JOIN hot ON k.key = hot.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY r, doc_id
"""
