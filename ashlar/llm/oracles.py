"""DuckDB SQL that computes the rows of the registered queries another way: by brute force, whole tables."""

from __future__ import annotations

from . import lm
from .linededup import RUN_UNITS, UNIT_WORDS
from .mixing import ALPHA, PART_RATE, SEED
from .quality import MAX_HOST_RATE, MAX_REPEAT_PERCENT, MIN_WORDS

WORD = r"[^\x20\x09-\x0D]+"

OP3 = f"""
WITH rates AS (
  SELECT source, power(n::double, {ALPHA}) / sum(power(n::double, {ALPHA})) OVER () * sum(n) OVER () / n AS rate
  FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)
),
parts AS (SELECT source, greatest(ceil(rate / {PART_RATE}), 1)::bigint AS parts, rate / greatest(ceil(rate / {PART_RATE}), 1) AS rate FROM rates),
placed AS (SELECT d.*, unnest(range(1, parts + 1)) AS part FROM documents d JOIN parts r ON d.source IS NOT DISTINCT FROM r.source),
drawn AS (
  SELECT *, ('0x' || substr(md5('{SEED}:' || doc_id || ':' || coalesce(text, '') || CASE WHEN part > 1 THEN ':' || part ELSE '' END), 1, 13))::bigint / 4503599627370496.0::double AS u
  FROM placed
),
steps AS (SELECT source, rate, unnest(range(ceil(rate + 12 * sqrt(rate) + 24)::bigint + 1)) AS k FROM parts),
sums AS (SELECT source, k, sum(CASE WHEN k = 0 THEN exp(-rate) ELSE exp(k * ln(rate) - rate - lgamma(k + 1)) END) OVER (PARTITION BY source ORDER BY k) AS upto FROM steps),
counted AS (
  SELECT doc_id, any_value(text) AS text, any_value(source) AS source, count(*) AS n
  FROM (SELECT d.doc_id, d.text, d.source FROM drawn d JOIN sums s ON d.source IS NOT DISTINCT FROM s.source AND d.u >= s.upto)
  GROUP BY doc_id
)
SELECT doc_id, source, text, copy::int AS copy, md5('{SEED + 1}:' || doc_id || ':' || coalesce(text, '') || ':' || copy) AS mix_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted)
"""

#: A turn conflicts as it stands if it holds its own closing marker or an escape; a conversation with a conflict
#: escapes every text that holds a backslash, [ or <.
OP4 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
judged AS (
  SELECT *,
    text LIKE '%\B%' OR text LIKE '%\L%' OR text LIKE '%\A%'
    OR contains(' ' || text || ' ', CASE role WHEN 'user' THEN ' [/INST] ' WHEN 'assistant' THEN ' </s> ' WHEN 'system' THEN ' <</SYS>> ' ELSE ' <|end|> ' END)
    OR contains(text, CASE role WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN ' </s>' WHEN 'system' THEN ' <</SYS>>' ELSE ' <|end|>' END) AS conflict,
    length(text) - length(replace(replace(replace(text, '\', ''), '[', ''), '<', '')) AS specials,
    CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 9 + length(role) + 10 + 8 END AS marks
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(length(text) + marks) + CASE WHEN bool_or(conflict) THEN sum(specials) ELSE 0 END)::bigint AS formatted_chars,
  bool_or(conflict)::bigint AS escape_level
FROM judged GROUP BY conv_id
"""

OP9 = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
windows AS (SELECT doc_id, i, word || ' ' || lead(word) OVER d || ' ' || lead(word, 2) OVER d AS win FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
counted AS (SELECT doc_id, i, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS again FROM windows),
covered AS (SELECT doc_id, again OR coalesce(lag(again) OVER d, false) OR coalesce(lag(again, 2) OVER d, false) AS hit FROM counted WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
repeats AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
measured AS (
  SELECT w.doc_id, source, len(words)::bigint AS n_words, length(array_to_string(words, ''))::bigint AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
    coalesce(lines.n, 0)::bigint AS n_dup_lines, coalesce(repeats.n, 0)::bigint AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
),
failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measured),
hosts AS (SELECT source, count(*)::double AS n, sum(base_failed::int)::double AS f FROM failed GROUP BY source),
moments AS (SELECT sum(f) / sum(n) AS m, var_pop(f / n) AS v, avg(1 / n) AS inv, sum(n) AS total FROM hosts),
prior AS (SELECT m, CASE WHEN v > m * (1 - m) * inv THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * inv) - 1, 1), total) ELSE total END AS k FROM moments),
rates AS (SELECT source, (f + m * k) / (n + k) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= {MAX_HOST_RATE} AS kept
FROM failed JOIN rates ON failed.source IS NOT DISTINCT FROM rates.source
"""

OP10 = rf"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS line FROM split),
bare AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM lines),
units AS (
  SELECT doc_id, line, t, unnest(range(1, (len(regexp_extract_all(t, '{WORD}')) + {UNIT_WORDS - 1}) // {UNIT_WORDS} + 1)) AS j
  FROM bare WHERE length(t) > 0
),
placed AS (SELECT doc_id, line, md5(t || '/' || j) AS h, row_number() OVER (PARTITION BY doc_id ORDER BY line, j) AS u FROM units),
runs AS (
  SELECT doc_id, u, string_agg(h, '') OVER (PARTITION BY doc_id ORDER BY u ROWS BETWEEN CURRENT ROW AND {RUN_UNITS - 1} FOLLOWING) AS content,
    count(*) OVER (PARTITION BY doc_id ORDER BY u ROWS BETWEEN CURRENT ROW AND {RUN_UNITS - 1} FOLLOWING) AS n
  FROM placed
),
later AS (SELECT doc_id, u FROM (SELECT doc_id, u, row_number() OVER (PARTITION BY content ORDER BY doc_id, u) AS k FROM runs WHERE n = {RUN_UNITS}) WHERE k > 1),
gone AS (
  SELECT DISTINCT p.doc_id, p.line FROM placed p
  JOIN (SELECT doc_id, unnest(range(u, u + {RUN_UNITS})) AS u FROM later) l ON p.doc_id = l.doc_id AND p.u = l.u
),
kept AS (
  SELECT b.doc_id, string_agg(b.raw, chr(10) ORDER BY b.line) FILTER (g.line IS NULL) AS text, count(g.line) AS n,
    coalesce(sum(length(b.t)) FILTER (g.line IS NULL), 0) AS left_chars
  FROM bare b LEFT JOIN gone g ON b.doc_id = g.doc_id AND b.line = g.line GROUP BY b.doc_id
)
SELECT d.doc_id, CASE WHEN coalesce(n, 0) = 0 THEN d.text WHEN left_chars = 0 THEN '' ELSE kept.text END AS text, coalesce(n, 0)::bigint AS n_removed_lines
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

ORACLES = {"op3_mixing": OP3, "op4_chat_formatting": OP4, "op9_quality_rules": OP9, "op10_line_dedup": OP10}

#: Shared shingles are counted for every pair that has any; components by the least id reachable.
OP8 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 2], ' ') END AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs p JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
reach AS (
  WITH RECURSIVE r(root, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.root, l.b FROM r JOIN links l ON r.node = l.a)
  SELECT node, min(root) AS component_id FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n, 0)::bigint AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN reach ON reach.node = d.doc_id
"""

ORACLES |= {"op8_minhash_near_dedup": OP8}

#: crc32 is computed bit by bit over the digits of the id.
OP1 = rf"""
WITH RECURSIVE crc(doc_id, digits, k, c) AS (
  SELECT doc_id, doc_id::varchar, 1, 4294967295::ubigint FROM documents
  UNION ALL
  SELECT doc_id, digits, k + 1, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::ubigint) ELSE a >> 1 END, xor(c, ord(digits[k])::ubigint))
  FROM crc WHERE k <= length(digits)
),
held AS (SELECT doc_id, xor(c, 4294967295::ubigint) % 5 = 1 AS held_out FROM crc WHERE k = length(digits) + 1),
w AS (SELECT d.doc_id, held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') || [' end'] AS words
  FROM documents d JOIN held ON d.doc_id = held.doc_id),
t AS (SELECT doc_id, held_out, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
p AS (SELECT *, coalesce(lag(word) OVER (PARTITION BY doc_id ORDER BY i), ' begin') AS h FROM t),
uni AS (SELECT word, count(*) AS c FROM p WHERE NOT held_out GROUP BY word),
bi AS (SELECT h, word, count(*) AS c FROM p WHERE NOT held_out GROUP BY h, word),
context AS (SELECT h, count(*) AS c FROM p WHERE NOT held_out GROUP BY h),
total AS (SELECT sum(c)::bigint AS n, count(*) AS v FROM uni),
tok AS (
  SELECT p.doc_id, p.held_out, uni.c AS c, (coalesce(uni.c, 0) + 0.5::double) / (n + 0.5::double * (v + 1)) AS p1, coalesce(bi.c, 0) AS c2, coalesce(context.c, 0) AS ch, n
  FROM p CROSS JOIN total LEFT JOIN uni ON p.word = uni.word LEFT JOIN bi ON p.word = bi.word AND p.h = bi.h LEFT JOIN context ON p.h = context.h
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(fsum(log10(p1)), 6) AS base_score,
  round(fsum(log10((c2 + {lm.STRENGTH}::double * p1) / (ch + {lm.STRENGTH}::double))), 6) AS score
FROM tok GROUP BY doc_id, held_out
"""

ORACLES |= {"op1_lm_scoring": OP1}

OP5 = r"""
WITH captures AS (
  SELECT page_id, url, (DATE '2024-01-01' + (page_id * 37 % 730)::int)::timestamp AS t,
    regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
hosts AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 7))::bigint AS h FROM captures WHERE host <> ''),
entries AS (
  SELECT host AS pattern, ['adult', 'malware', 'phishing', 'spam'][h % 4 + 1] AS category, h % 400 + d AS day, act FROM hosts, (VALUES (0, 'add'), (120, 'remove'), (240, 'add')) AS v(d, act) WHERE h % 3 = 0
  UNION ALL SELECT host || '/en', ['adult', 'malware', 'phishing', 'spam'][h % 4 + 1], h % 600, 'add' FROM hosts WHERE h % 5 = 1
),
dated AS (
  SELECT pattern, category, (DATE '2024-01-01' + day::int)::timestamp AS since, act FROM entries
  UNION ALL VALUES ('example.org', 'parked', TIMESTAMP '2025-06-01', 'add'), ('example.org', 'parked', TIMESTAMP '2025-07-01', 'remove'),
    ('example.net', 'parked', TIMESTAMP '2024-03-01', 'add'), ('example.net', 'parked', TIMESTAMP '2024-03-15', 'remove')
),
valid AS (SELECT pattern, category, since AS f, lead(since) OVER (PARTITION BY pattern, category ORDER BY since) AS e, act FROM dated),
hits AS (
  SELECT page_id, count(*) AS n, string_agg(pattern || ' ' || category, ',' ORDER BY pattern || ' ' || category) AS matched
  FROM captures JOIN valid ON act = 'add' AND f <= t AND (e IS NULL OR t < e)
    AND (host = pattern OR ends_with(host, '.' || pattern) OR starts_with(host || path || '/', pattern || '/'))
  GROUP BY page_id
)
SELECT c.page_id, url, n IS NOT NULL AS blocked, coalesce(n, 0)::bigint AS n_matches, coalesce(matched, '') AS matched
FROM captures c LEFT JOIN hits ON c.page_id = hits.page_id
"""

ORACLES |= {"op5_url_filters": OP5}

#: Prefixes are told apart by the running list of their turns' hashes; what is below a node is found along each node's own conversation.
OP11 = r"""
WITH RECURSIVE crc(conv_id, digits, k, c) AS (
  SELECT DISTINCT conv_id, conv_id::varchar, 1, 4294967295::ubigint FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id, digits, k + 1, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::ubigint) ELSE a >> 1 END, xor(c, ord(digits[k])::ubigint))
  FROM crc WHERE k <= length(digits)
),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, (xor(c, 4294967295::ubigint) % 6)::bigint AS h FROM crc WHERE k = length(digits) + 1),
given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
placed AS (SELECT conv_id, sha256(length(role) || '/' || role || '/' || text) AS t, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM given),
built AS (
  SELECT c.conv_id, 0 AS own, i, t, chars FROM convs c JOIN placed p ON p.conv_id = c.base AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, t, chars FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND i > h
),
steps AS (
  SELECT conv_id, chars, row_number() OVER o AS depth, string_agg(t, '/') OVER o AS path, lead(i) OVER o IS NULL AS is_end FROM built WINDOW o AS (PARTITION BY conv_id ORDER BY own, i)
),
walked AS (
  SELECT conv_id, depth, sha256(path) AS node, chars, is_end FROM steps
  UNION ALL SELECT c.conv_id, 0, 'root', 0, s.conv_id IS NULL FROM convs c LEFT JOIN steps s ON s.conv_id = c.conv_id AND s.depth = 1
),
nodes AS (SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (is_end) AS ends FROM walked GROUP BY node),
edges AS (SELECT n.node, p.node AS parent, q.conv_id AS parent_conv_id FROM nodes n JOIN walked p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN nodes q ON q.node = p.node),
children AS (SELECT parent AS node, count(*) AS n FROM edges GROUP BY parent),
below AS (
  SELECT w.node, sum((c.node IS NULL)::bigint) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
  FROM nodes n JOIN walked w ON w.conv_id = n.conv_id AND w.depth <= n.depth LEFT JOIN children c ON c.node = n.node GROUP BY w.node
)
SELECT n.conv_id, n.depth::bigint AS depth, parent_conv_id, n_convs, coalesce(c.n, 0)::bigint AS n_children, n_leaves::bigint AS n_leaves, saved::bigint AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes n LEFT JOIN edges e ON e.node = n.node LEFT JOIN children c ON c.node = n.node JOIN below b ON b.node = n.node
"""

ORACLES |= {"op11_prefix_trie": OP11}

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
drawn AS (SELECT *, [('0x' || x[1:8])::bigint, ('0x' || x[9:16])::bigint, ('0x' || x[17:24])::bigint, ('0x' || x[25:32])::bigint] AS h FROM d),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
parts AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cut)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

ORACLES |= {"op12_fill_in_middle": OP12}

#: The checksum goes byte by byte through a table that is made by its rule; the jumps are made one after the other in 128-bit numbers.
OP13 = r"""
WITH RECURSIVE steps AS (
  SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::ubigint) ELSE a >> 1 END, x::ubigint) ORDER BY x) AS tab FROM range(256) r(x)
),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents),
sums AS (
  SELECT doc_id, octet_length(body) + 16 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(body), '..'), lambda x: ('0x' || x)::ubigint), lambda c, b: xor(c >> 8, tab[(xor(c, b) % 256 + 1)::bigint]), 4294967295::ubigint), 4294967295::ubigint) AS crc
  FROM d, steps
),
jumps(doc_id, key, b, j) AS (
  SELECT DISTINCT doc_id, CASE WHEN doc_id < 0 THEN doc_id::hugeint + 18446744073709551616::hugeint ELSE coalesce(doc_id, 0)::hugeint END, -1::bigint, 0::bigint FROM documents
  UNION ALL
  SELECT doc_id, k, j, floor((j + 1) * (2147483648::double / ((k // 8589934592::hugeint) + 1)::double))::bigint
  FROM (SELECT doc_id, j, (key * 2862933555777941757::hugeint + 1) % 18446744073709551616::hugeint AS k FROM jumps WHERE j < 40)
),
placed AS (SELECT doc_id, b AS shard, CASE WHEN j = 40 THEN 40 ELSE b END AS grown_shard FROM jumps WHERE j >= 40)
SELECT s.doc_id, size::bigint AS size, crc::bigint AS text_crc32, 'key' AS law, shard::int AS shard, grown_shard::int AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY s.doc_id NULLS FIRST, size, crc) - 1 AS slot
FROM sums s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id
"""

ORACLES |= {"op13_sharding": OP13}
