"""DuckDB SQL of the operators that SQL can express."""

OP5_QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents
), w AS (
  SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), win AS (
  SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
  FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i)
), rep AS (
  SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, tri) > 1
), covered AS (
  SELECT k, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS v(o) GROUP BY k
), raw AS (
  SELECT k, source, unnest(string_split(t, chr(10))) AS line FROM d
), line AS (
  SELECT k, source, line,
    trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), hashed AS (
  SELECT *, ('0x' || substr(md5(norm), 1, 15))::BIGINT AS h FROM line
), dups AS (
  SELECT k, count(*) - count(DISTINCT line) AS n FROM line GROUP BY k
), ranked AS (
  SELECT DISTINCT k, source, h FROM hashed
), digest AS (
  SELECT k, list(h ORDER BY h) AS hs FROM ranked GROUP BY k
), freq AS (
  SELECT source, h, count(DISTINCT hs) AS n FROM ranked JOIN digest USING (k) GROUP BY source, h
), host AS (
  SELECT source, count(*) AS n_docs FROM d GROUP BY source
), above AS (
  SELECT f.source, f.h FROM freq f JOIN host g ON f.source IS NOT DISTINCT FROM g.source
  WHERE f.n > greatest(20, floor(g.n_docs * 10 / 1000))
), lost AS (
  SELECT l.k, sum(nw) AS lost_words, count(*) AS n_lines
  FROM hashed l JOIN above a ON l.h = a.h AND l.source IS NOT DISTINCT FROM a.source GROUP BY l.k
), m AS (
  SELECT d.k, d.doc_id, len(ws) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_removed_lines, len(ws) - coalesce(lost_words, 0) AS kept_words
  FROM d JOIN w USING (k) LEFT JOIN dups USING (k) LEFT JOIN covered USING (k) LEFT JOIN lost USING (k)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  n_removed_lines::BIGINT AS n_removed_lines, kept_words::BIGINT AS kept_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND NOT (kept_words < 50 AND 100 * kept_words < 50 * n_words) AS kept
FROM m
"""

OP7_CHAT_FORMATTING = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), p AS (
  SELECT *, row_number() OVER w AS place, list({'role': role, 'text': text}) OVER w AS so_far
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), hashed AS (
  SELECT * EXCLUDE (so_far), md5(to_json(so_far)::VARCHAR) AS h, max(place) OVER (PARTITION BY conv_id) AS n_turns FROM p
), whole AS (
  SELECT n_turns, h, min(conv_id) AS conv_id FROM hashed WHERE place = n_turns GROUP BY n_turns, h
), prefix AS (
  SELECT DISTINCT place, h FROM hashed WHERE place < n_turns
), kept AS (
  SELECT conv_id FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefix x WHERE x.place = w.n_turns AND x.h = w.h)
)
SELECT h.conv_id, place::BIGINT AS place, n_turns::BIGINT AS n_turns, role,
  '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered,
  coalesce(role, '') = 'assistant' AS is_target
FROM hashed h JOIN kept k ON h.conv_id IS NOT DISTINCT FROM k.conv_id
"""
