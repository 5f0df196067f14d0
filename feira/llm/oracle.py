"""The queries that SQL can express, as DuckDB SQL written from their meaning."""

from __future__ import annotations

from feira.llm.line_dedup import BLOCKS, LEAST_PAGES, RATIO

WORD = r"[^\x20\x09-\x0D]+"

WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS body
  FROM pages
), g AS (SELECT body, max(page_id) AS newest FROM p WHERE payload_bytes >= 1000 GROUP BY body)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN newest > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN newest > page_id THEN newest END AS refers_to
FROM p LEFT JOIN g USING (body)
"""

NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION
  SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b
), root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN root USING (doc_id)
"""

LINES = rf"""
WITH t AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    string_split(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'),
      '(?i)</?(?:{"|".join(BLOCKS.split())})\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'), chr(10)) AS lines
  FROM pages
), l AS (
  SELECT DISTINCT page_id, host, trim(unnest(lines), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM t
), bad AS (
  SELECT host, line FROM l JOIN (SELECT host, count(*) AS pages FROM t GROUP BY host) USING (host)
  WHERE line <> '' GROUP BY host, line, pages HAVING count(*) >= {LEAST_PAGES} AND count(*) > {RATIO} * pages
), bads AS (SELECT host, list(line) AS bad FROM bad GROUP BY host)
SELECT page_id, host, len(lines) AS n_lines,
  array_to_string(list_filter(lines, lambda x:
    NOT list_contains(coalesce(bad, []), trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))), chr(10)) AS kept_text
FROM t LEFT JOIN bads USING (host)
"""

QUALITY = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), b AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines,
    greatest(51, len(ws) // 10 + 1) AS long
  FROM w
), grams AS (
  SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, array_to_string(ws[i:i + 7], ' ') AS gram FROM w
), starts AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(least(8, coalesce(after - i, 8))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM starts) GROUP BY doc_id
), passage_grams AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, array_to_string(ws[i:i + 19], ' ') AS gram FROM w
), passage_starts AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM passage_grams) WHERE n > 1
), passages AS (
  SELECT doc_id, sum(least(20, coalesce(after - i, 20))) AS n_passage_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM passage_starts) GROUP BY doc_id
), longs AS (
  SELECT DISTINCT doc_id FROM (
    SELECT doc_id, unnest(range(1, len(ws) - long + 2)) AS i, array_to_string(ws[i:i + long - 1], ' ') AS run FROM w JOIN b USING (doc_id)
  ) GROUP BY doc_id, run HAVING count(*) > 1
), j AS (
  SELECT b.*, coalesce(n_repeat_words, 0) AS n_repeat_words, longs.doc_id IS NOT NULL AS long_repeat,
    n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed,
    100 * coalesce(n_passage_words, 0) > 20 * n_words AS much_covered
  FROM b LEFT JOIN covered USING (doc_id) LEFT JOIN passages USING (doc_id) LEFT JOIN longs USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT much_covered AND NOT long_repeat AS kept
FROM j
"""

BENCHMARK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

CONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BENCHMARK_WORD}') AS ws
  FROM documents
), q AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BENCHMARK_WORD}') AS ws
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, size, array_to_string(ws[i:i + size - 1], ' ') AS gram
  FROM (SELECT item, ws, least(13, len(ws)) AS size, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM q WHERE len(ws) > 0)
), grams AS (
  SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows))
), met AS (SELECT doc_id, item, i, size FROM grams JOIN windows USING (size, gram)),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# crc32 bit by bit: the reversed polynomial is a fixed value
TRIE = r"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce("text", '') AS body FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, role, body, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || body)) AS k FROM t
), lengths AS (
  SELECT c, count(*) AS n, c - c % 20 AS base, xor(4294967295, list_reduce(
    list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT)),
    lambda crc, x: list_reduce(range(CAST(8 AS BIGINT)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(crc, x)),
    CAST(4294967295 AS BIGINT))) % 4 AS h
  FROM t GROUP BY c
), plans AS (
  SELECT a.c, a.h, a.base, least(a.h, coalesce(b.n, 0)) AS head, head + greatest(0, a.n - a.h) AS total
  FROM lengths a LEFT JOIN lengths b ON b.c = a.base
), rebuilt AS (
  SELECT p.c, k AS d, role, body FROM plans p JOIN own ON own.c = base AND k <= h
  UNION ALL
  SELECT p.c, head + k - h, role, body FROM plans p JOIN own ON own.c = p.c AND k > h
), paths AS (
  SELECT c, d, body, list([role, body]) OVER (PARTITION BY c ORDER BY d) AS path FROM rebuilt
  UNION ALL SELECT c, 0, '', [] FROM plans
), nodes AS (
  SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * len(regexp_extract_all(any_value(body), '[^\x20\x09-\x0D]+')) AS saved
  FROM paths GROUP BY path, d
), kids AS (
  SELECT path[:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2
), sums AS (
  SELECT p.path, p.d AS depth, sum(x.saved) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM nodes x LEFT JOIN kids ON kids.path = x.path AND kids.depth = x.depth
  JOIN paths p ON p.c = x.conv_id AND p.d <= x.depth GROUP BY 1, 2
), ends AS (
  SELECT path, d AS depth, sha256(string_agg(c, ',' ORDER BY c)) AS ends_sha256
  FROM paths JOIN plans USING (c) WHERE d = total GROUP BY 1, 2
)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes x JOIN sums USING (path, depth) LEFT JOIN kids USING (path, depth) LEFT JOIN ends USING (path, depth)
LEFT JOIN nodes up ON up.depth = x.depth - 1 AND up.path = x.path[:x.depth - 1]
"""

MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce("text", ''), '{WORD}')) AS size,
    substr(sha256('42' || coalesce(':' || doc_id, '')), 1, 16) AS shuffle, coalesce(doc_id, -9223372036854775808) AS key,
    row_number() OVER (PARTITION BY doc_id, source, size) AS number
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank,
    rank % 3 + 1 AS weight, 3 * source_size AS most
  FROM d GROUP BY source
), f AS (
  SELECT *, CAST(sum(most) OVER a AS BIGINT) AS most_until, CAST(sum(weight) OVER () AS BIGINT) AS weights,
    CAST(sum(weight) OVER () - sum(weight) OVER a AS BIGINT) AS weight_left, CAST(sum(source_size) OVER () AS BIGINT) AS budget
  FROM s WINDOW a AS (ORDER BY most / weight, rank ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT greatest(max(budget / weights), max(CASE WHEN weight_left > 0 THEN (budget - most_until) / weight_left END)) AS level, max(budget) AS budget FROM f
), q AS (
  SELECT d.*, source_size, rank, least(weight * level, CAST(most AS DOUBLE)) AS target, budget,
    CAST(sum(size) OVER (PARTITION BY rank ORDER BY shuffle, key, size, number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS until
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l
), e AS (
  SELECT *, (turn * source_size + until) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0
), o AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, shuffle, key, size, number, turn ROWS UNBOUNDED PRECEDING) AS all_until FROM e
), n AS (
  SELECT rank, key, size, number, count(*) AS times FROM o WHERE all_until <= budget GROUP BY ALL
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * coalesce(times, 0) AS BIGINT) AS taken
FROM q LEFT JOIN n USING (rank, key, size, number)
"""

FIM = r"""
WITH d AS (
  SELECT doc_id, coalesce("text", '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, body, regexp_extract_all(body, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS draws
  FROM d
), c AS (
  SELECT *, len(units) AS n, least(draws[1] % (n + 1), draws[2] % (n + 1)) AS a, greatest(draws[1] % (n + 1), draws[2] % (n + 1)) AS b,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR draws[3] % 100 >= 50 THEN 'plain'
         WHEN draws[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(body) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc": WARC,
        "op6_near_dedup": NEAR,
        "op7_line_dedup": LINES,
        "op8_quality_rules": QUALITY,
        "op10_decontamination": CONTAMINATION,
        "op11_conversation_trie": TRIE,
        "op12_source_mix": MIX,
        "op13_fill_in_middle": FIM,
    }
