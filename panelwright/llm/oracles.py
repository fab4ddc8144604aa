"""DuckDB statements for the queries that SQL can express on whole tables."""

_WORD = r"[^\x20\x09-\x0D]+"

OP3 = r"""
WITH lines AS (
  SELECT rowid AS r, doc_id, source, u.pos, u.line,
         regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents) d,
       LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS pos) u
), spread AS (
  SELECT bare FROM lines WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 10
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(s.bare) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.bare IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN spread s USING (bare) GROUP BY r, doc_id
UNION ALL
SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), sha256('') FROM documents WHERE text IS NULL
"""

OP5 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), marked AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS i,
         length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS n_escaped
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n_escaped + CASE WHEN before = role THEN length('<|im_next|>')
                                 ELSE length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP9 = r"""
WITH RECURSIVE sized AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS src, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(text) AS k,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')), 1, 8) AS BIGINT) AS h
  FROM documents
), total AS (SELECT CAST(sum(size) AS BIGINT) AS n FROM sized),
ranked AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY src, source
), weighted AS (
  SELECT *, [5, 2, 1][CAST((rank - 1) % 3 + 1 AS INTEGER)] AS weight, 2.0::DOUBLE * source_size AS cap FROM ranked
), levels AS (
  SELECT *, ((SELECT 1.5::DOUBLE * n FROM total) - coalesce(sum(cap) OVER o, 0.0)) /
            ((SELECT sum(weight) FROM weighted) - coalesce(sum(weight) OVER o, 0)) AS level
  FROM weighted WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT src, source_size, greatest(1, source_size // 65536) AS n_blocks,
         least(cap, coalesce((SELECT max(level) FROM levels WHERE level * weight <= cap) * weight, cap)) AS target
  FROM levels
), goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS passes, CAST(round(target) AS BIGINT) AS goal FROM targets
), d AS (
  SELECT s.*, h % n_blocks AS block, source_size, target, passes, goal - passes * source_size AS rest FROM sized s JOIN goals USING (src)
), blocks AS (
  SELECT src, block, CAST('0x' || substr(md5('0:' || src || ':' || block), 1, 8) AS BIGINT) AS turn, CAST(sum(size) AS BIGINT) AS words, any_value(rest) AS rest
  FROM d GROUP BY src, block
), placed AS (
  SELECT *, CAST(coalesce(sum(words) OVER (PARTITION BY src ORDER BY turn, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead FROM blocks
), edge AS (
  SELECT r, d.src, size, rest - ahead AS left0, row_number() OVER (PARTITION BY d.src ORDER BY size DESC, h, doc_id NULLS FIRST, k NULLS FIRST) AS i
  FROM d JOIN placed p USING (src, block, rest) WHERE size > 0 AND ahead < rest AND ahead + words > rest
), walk(src, i, r, took, left_words) AS (
  SELECT src, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), FALSE, any_value(left0) FROM edge GROUP BY src
  UNION ALL
  SELECT e.src, e.i, e.r, e.size <= w.left_words, CASE WHEN e.size <= w.left_words THEN w.left_words - e.size ELSE w.left_words END
  FROM walk w JOIN edge e ON e.src = w.src AND e.i = w.i + 1
)
SELECT d.doc_id, d.size, d.source_size, d.target,
       CAST(d.size * (d.passes + CASE WHEN ahead + words <= d.rest THEN 1 WHEN w.took THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN placed p USING (src, block) LEFT JOIN walk w ON w.r = d.r
"""

OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT r, CAST(count(DISTINCT j) AS BIGINT) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r
), lines AS (
  SELECT r, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
         len(regexp_extract_all(text, '\p{L}')) AS n_letters,
         len(list_filter(ws, lambda x: len(x) > 2 AND x LIKE '%!!')) + len(list_filter(ws, lambda x: x = '!!')) AS n_bangs,
         len(list_filter(ws, lambda x: len(regexp_extract_all(x, '[A-Z]')) > 1 AND NOT regexp_matches(x, '[a-z]'))) AS n_caps_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>]$') OR regexp_matches(x, '^[#*$%&|<>]'))) AS n_marked
  FROM w LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r)
), bits AS (
  SELECT *, CAST(
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_upper > 30 * n_letters THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_caps_words > 25 * n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_bangs > n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_marked > 10 * n_words THEN 64 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 128 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 256 ELSE 0 END
    + CASE WHEN 2 * n_letters < word_chars THEN 512 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits,
       'standard-v1' AS policy, CASE WHEN fail_bits & (fail_bits - 1) = 0 THEN fail_bits ELSE 0 END AS sole_failure
FROM bits
"""

ORACLES = {
    "op3_line_dedup": OP3,
    "op5_chat_format": OP5,
    "op9_mixing": OP9,
    "op10_quality_rules": OP10,
}
