"""DuckDB SQL of the corpus queries that SQL can express."""

OP4 = """
WITH counts AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
whole AS (SELECT sum(n) AS rows_, sum(sqrt(n)) AS sum_w FROM counts),
rates AS (SELECT source, rows_ * pow(n, 0.5) / (sum_w * n) AS rate FROM counts, whole),
steps AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rates),
pmf AS (SELECT source, k, exp(-rate + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) - lgamma(k + 1) END) AS p FROM steps),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
units AS (SELECT doc_id, source, text, ('0x' || substr(md5('17:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT un.doc_id, un.source, un.text, count(*) FILTER (WHERE c.c <= un.u)::INTEGER AS n_copies FROM units un JOIN cdf c ON un.source IS NOT DISTINCT FROM c.source GROUP BY ALL),
copies AS (SELECT doc_id, source, text, n_copies, unnest(range(1, n_copies + 1))::INTEGER AS copy_no FROM counted)
SELECT doc_id, source, copy_no, n_copies, md5('17:' || doc_id || ':' || copy_no) AS shuffle_key, text FROM copies
"""

OP7 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS w,
             string_split(t, chr(10)) AS raw_lines FROM d),
g AS (SELECT doc_id, t, w, raw_lines, list_filter(raw_lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
             list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i : i + 7], ' ')) AS grams FROM w),
wins AS (SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS pos FROM g WHERE len(grams) > 1),
dup AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM wins) WHERE n > 1),
gaps AS (SELECT doc_id, least(8, pos - lag(pos, 1, -7) OVER (PARTITION BY doc_id ORDER BY pos)) AS fresh FROM dup),
rep AS (SELECT doc_id, sum(fresh)::BIGINT AS n FROM gaps GROUP BY doc_id),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(raw_lines) AS n_lines
      FROM g LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words * 3 OR word_chars > 25 * n_words OR word_chars < 2 * n_words OR n_dup_lines * 10 > 3 * n_lines OR n_letters * 10 < word_chars * 6) AS kept
FROM f
"""

OP8 = r"""
WITH r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
p AS (SELECT page_id, coalesce(lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
      FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

#: Integer vectors and their inner products with the rows whose id is divisible by 50.
_VECTORS = """
WITH v AS (SELECT vec_id, label::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
"""

OP11 = _VECTORS + """
, s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

OP12 = r"""
WITH RECURSIVE crc_step AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n::BIGINT)) AS t),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (SELECT named.* EXCLUDE (k), xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS code FROM named, crc_step),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded),
placed AS (SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
                  lag(left(role, 1)) OVER w AS before, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS shown
           FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faulty AS (SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM faulty GROUP BY conv_id),
-- what is open: 0 nothing read, 1 after the system turn, 2 a reply, 3 after a pair; an edit leads from one to another
edits(old, new, edit, letter, price, line) AS (VALUES (0, 1, 'K', 's', 0, ''), (0, 2, 'K', 'u', 0, ''), (1, 2, 'K', 'u', 0, ''), (2, 3, 'K', 'a', 0, ''), (3, 2, 'K', 'u', 0, ''),
  (0, 2, 'R', '', 2, 'user'), (1, 2, 'R', '', 2, 'user'), (2, 3, 'R', '', 2, 'assistant'), (3, 2, 'R', '', 2, 'user'),
  (0, 2, 'I', '', 2, 'user'), (1, 2, 'I', '', 2, 'user'), (2, 3, 'I', '', 2, 'assistant'), (3, 2, 'I', '', 2, 'user'),
  (0, 0, 'D', '', 3, ''), (1, 1, 'D', '', 3, ''), (2, 2, 'D', '', 3, ''), (3, 3, 'D', '', 3, '')),
-- round 3 p handles row p; rounds 3 p + 1 and 3 p + 2 insert, each state keeping its cheapest and ASCII-least way
ways AS (
  SELECT conv_id, 0::BIGINT AS step, 0 AS open, 0::BIGINT AS cost, '' AS audit, [] ::VARCHAR[] AS lines FROM sums
  UNION ALL
  SELECT conv_id, step, open, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, open ORDER BY cost, audit) AS best FROM (
      SELECT w.conv_id, w.step + 1 AS step, e.new AS open, w.cost + e.price + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END AS cost, w.audit || e.edit AS audit,
             CASE WHEN e.edit = 'D' THEN w.lines ELSE list_append(w.lines, CASE e.edit WHEN 'K' THEN f.role ELSE e.line END || ':' || f.text) END AS lines
      FROM ways w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND w.step % 3 = 2 AND f.pos = w.step // 3 + 1
           JOIN edits e ON e.old = w.open AND (e.edit = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR (e.edit = 'K' AND e.letter = left(f.role, 1)))))
      UNION ALL
      SELECT w.conv_id, w.step + 1, e.new, w.cost + e.price, w.audit || e.edit, list_append(w.lines, e.line || ':') FROM ways w JOIN edits e ON e.old = w.open AND e.edit = 'I' WHERE w.step % 3 <> 2
      UNION ALL
      SELECT w.conv_id, w.step + 1, w.open, w.cost, w.audit, w.lines FROM ways w WHERE w.step % 3 <> 2)) WHERE best = 1),
ended AS (SELECT w.conv_id, w.cost, w.audit, w.lines, row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost, w.audit) AS best
          FROM ways w JOIN sums s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.step = 3 * s.n + 2 WHERE w.open IN (0, 3))
SELECT o.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate, coalesce(s.truncated, 0)::BIGINT AS truncated,
       coalesce(s.illegal, 0)::BIGINT AS illegal, coalesce(e.cost, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id AND e.best = 1
"""

OP13 = _VECTORS + """
, l AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, e FROM v WHERE label IS NOT NULL),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, c.label = q.label AS same, list_dot_product(q.e, c.e)::BIGINT AS score FROM l q JOIN l c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT * FROM n WHERE rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_poisson_mixing": OP4, "op7_quality_cascade": OP7, "op8_url_rules": OP8, "op11_bit_sliced_top_k": OP11, "op12_conversation_repair": OP12, "op13_hard_negatives": OP13}
