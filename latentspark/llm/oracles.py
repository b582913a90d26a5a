"""DuckDB SQL of the queries that SQL can express. Each is written from the contract, not from the operator."""

from __future__ import annotations

from latentspark.llm.oracle_simhash import OP5

OP1 = """
WITH v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fine AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a) SELECT a, b FROM r
), component AS (
  SELECT v.vec_id, least(v.vec_id, coalesce(min(reach.b), v.vec_id)) AS component_id FROM v LEFT JOIN reach ON v.vec_id = reach.a GROUP BY v.vec_id
)
SELECT v.vec_id, CAST(count(l.b) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN links l ON v.vec_id = l.a JOIN component c ON v.vec_id = c.vec_id GROUP BY v.vec_id, c.component_id
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lines AS (
  SELECT doc_id, source, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), windows AS (
  SELECT doc_id, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d)
), twice AS (
  SELECT doc_id, w FROM windows GROUP BY doc_id, w HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT windows.doc_id, unnest(range(i, i + 8)) AS p FROM windows JOIN twice ON windows.doc_id = twice.doc_id AND windows.w = twice.w
  ) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, source, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id
), texts AS (
  SELECT DISTINCT source, text FROM d
), normal AS (
  SELECT source, text, line, len(string_split(line, ' ')) AS words FROM (
    SELECT source, text, trim(unnest(string_split(regexp_replace(regexp_replace(lower(text), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), chr(10)))) AS line FROM texts
  ) WHERE line <> ''
), hosts AS (
  SELECT source, count(*) AS n FROM texts GROUP BY source
), above AS (
  SELECT f.source, line FROM (SELECT source, line, count(DISTINCT text) AS n FROM normal GROUP BY source, line) f
  JOIN hosts ON f.source IS NOT DISTINCT FROM hosts.source WHERE f.n > 20 AND (f.n > 0.05 * hosts.n OR f.n > 100)
), removed AS (
  SELECT normal.source, text, sum(words) AS n FROM normal JOIN above ON normal.source IS NOT DISTINCT FROM above.source AND normal.line = above.line GROUP BY normal.source, text
)
SELECT b.doc_id, n_words, word_chars, n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CAST(coalesce(r.n, 0) AS BIGINT) AS removed_words,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND NOT coalesce(r.n IS NOT NULL AND (n_words - r.n < 0.3 * n_words OR n_words - r.n < 20), FALSE) AS kept
FROM base b JOIN lines ON b.doc_id = lines.doc_id LEFT JOIN removed r ON b.source IS NOT DISTINCT FROM r.source AND b.text = r.text
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 4) AS INTEGER) AS bucket
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), filled AS (
  SELECT *, row_number() OVER before AS place, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM s WINDOW before AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT arg_min(level, place) AS level FROM filled WHERE level * weight <= 3 * source_size
), t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), water.level * weight) AS target,
    CASE WHEN source_size > 0 THEN CAST(floor(least(CAST(3 * source_size AS DOUBLE), water.level * weight) / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM s, water
), running AS (
  SELECT source, bucket, sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket) AS words FROM d GROUP BY source, bucket
), nearest AS (
  SELECT t.source, t.target - t.whole * t.source_size AS need, abs(words - (t.target - t.whole * t.source_size)) AS gap, bucket,
    row_number() OVER (PARTITION BY t.source ORDER BY abs(words - (t.target - t.whole * t.source_size)), bucket) AS place
  FROM running JOIN t ON running.source IS NOT DISTINCT FROM t.source
)
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(d.size * (t.whole + CASE WHEN n.gap < n.need AND d.bucket <= n.bucket THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN nearest n ON d.source IS NOT DISTINCT FROM n.source AND n.place = 1
"""

OP10 = r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) + 16 AS chars FROM c
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: crc32 of the decimal digits of an id, bit by bit over each character.
HELD_OUT = """crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda c, x:
    list_reduce(list_prepend(xor(c, x), CAST(range(0, 8) AS BIGINT[])), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT) % 4 = 2 AS held_out FROM documents
)"""

OP8 = "WITH " + HELD_OUT + r""", d AS (
  SELECT documents.doc_id, lang, text, held_out, CASE WHEN regexp_matches(text, '\p{L}') THEN ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{M}]+', ' ', 'g')) || ' ' ELSE '' END AS t FROM documents JOIN crc ON documents.doc_id = crc.doc_id
), sample AS (
  SELECT doc_id, lang, t FROM d WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('sample:' || doc_id), doc_id) <= 1500
), sizes AS (SELECT unnest([1, 2, 3]) AS k), taught AS (
  SELECT lang, substr(t, i, k) AS g, count(*) AS n FROM (SELECT lang, t, k, unnest(range(1, length(t) - k + 2)) AS i FROM sample, sizes WHERE length(t) > 2) GROUP BY ALL
), profile AS (
  SELECT * FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) - 1 AS place FROM taught WHERE g <> ' ') WHERE place < 400
), own AS (
  SELECT doc_id, substr(t, i, k) AS g, count(*) AS n FROM (SELECT doc_id, t, k, unnest(range(1, length(t) - k + 2)) AS i FROM d, sizes WHERE length(t) > 2) GROUP BY ALL
), mine AS (
  SELECT * FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS place FROM own WHERE g <> ' ') WHERE place < 400
), langs AS (SELECT DISTINCT lang FROM profile), apart AS (
  SELECT mine.doc_id, langs.lang, sum(CASE WHEN p.place IS NULL THEN 400 ELSE abs(p.place - mine.place) END) / CAST(400 * count(*) AS DOUBLE) AS distance
  FROM mine CROSS JOIN langs LEFT JOIN profile p ON p.lang = langs.lang AND p.g = mine.g GROUP BY mine.doc_id, langs.lang
), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) AS place FROM apart)
SELECT d.doc_id, d.held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1.0 - distance, 0.0) AS score FROM d LEFT JOIN best ON d.doc_id = best.doc_id AND best.place = 1
"""

OP11 = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, sha256(length(role) || ':' || role || text) AS said, length(text) AS chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS k FROM t
), ids AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda v, x:
    list_reduce(list_prepend(xor(v, x), CAST(range(0, 8) AS BIGINT[])), lambda w, k: xor(w >> 1, (w & 1) * 3988292384))), 4294967295::BIGINT) % 6 AS h FROM (SELECT DISTINCT c FROM own)
), seq AS (
  SELECT c, said, chars, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d FROM (
    SELECT ids.c, 0 AS part, k, said, chars FROM ids JOIN own ON own.c = ids.c - ids.c % 100 AND k <= h
    UNION ALL SELECT ids.c, 1, k, said, chars FROM ids JOIN own ON own.c = ids.c AND k > h)
), path AS (
  SELECT c, d, sha256(string_agg(said, '') OVER (PARTITION BY c ORDER BY d)) AS key, chars FROM seq UNION ALL SELECT c, 0, '', 0 FROM ids
), node AS (
  SELECT key, any_value(d) AS d, min(c) AS c, count(*) AS n, any_value(chars) AS chars FROM path GROUP BY key
), linked AS (
  SELECT node.*, up.key AS up, parent.c AS up_c FROM node LEFT JOIN path up ON up.c = node.c AND up.d = node.d - 1 LEFT JOIN node parent ON parent.key = up.key
), counted AS (
  SELECT linked.*, coalesce(m, 0) AS m FROM linked LEFT JOIN (SELECT up, count(*) AS m FROM linked GROUP BY up) x ON x.up = linked.key
), below AS (
  SELECT path.key, sum(CAST(m = 0 AS INT)) AS leaves, sum((n - 1) * counted.chars) AS saved FROM counted JOIN path ON path.c = counted.c AND path.d <= counted.d GROUP BY path.key
), ends AS (
  SELECT key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS listed FROM (SELECT * FROM path QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1) GROUP BY key
)
SELECT counted.c AS conv_id, CAST(d AS BIGINT) AS depth, up_c AS parent_conv_id, CAST(n AS BIGINT) AS n_convs, CAST(m AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(listed, '')) AS ends_sha256
FROM counted JOIN below ON below.key = counted.key LEFT JOIN ends ON ends.key = counted.key
"""

SQL = {"op1_embedding_dedup": OP1, "op3_line_rules": OP3, "op5_simhash": OP5, "op6_mixing": OP6, "op8_language_id": OP8, "op10_chat": OP10, "op11_prefix_trie": OP11}
