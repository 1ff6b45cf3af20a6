"""DuckDB SQL for those operators that SQL can express."""

EXACT_DEDUP = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""

URL_FILTER = r"""
WITH p AS (SELECT page_id,
       translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(h, q, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path, (SELECT arg_max(h || q, length(h || q)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS rule,
       coalesce((SELECT arg_max(verdict, length(h || q)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)), 'allow') AS verdict
FROM p
"""

CHAT_FORMATTING = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|SYS\]|NULL\]|/?ROLE\])', '\1\\\2\3', 'g') AS safe,
             regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|SYS\]|NULL\]|/?ROLE\])', '\1\\\2\3', 'g') AS safe_role FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(7 + length(safe) + CASE WHEN role IS NULL THEN 6 WHEN role = 'user' THEN 6 WHEN role = 'assistant' THEN 7 WHEN role = 'system' THEN 5 ELSE 13 + length(safe_role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

SOURCE_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 30),
l AS (SELECT lang, count(*) AS kept, sum(lang_n) AS lang_total FROM k GROUP BY ALL),
n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (total + 5 * kept)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * kept)::HUGEINT AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
v AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT s.lang, s.source, t.source AS item, sum(abs(s.p - t.p)) AS value FROM p s JOIN p t ON s.lang = t.lang AND s.term = t.term GROUP BY ALL) x
             ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
t AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM v
UNION ALL SELECT lang, source, 'term', item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM t) WHERE rank <= 50
"""

# crc32 of the decimal id: bits of each byte's table entry, then one step a byte
CONVERSATION_TRIE = r"""
WITH src AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, t, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS pos
      FROM (SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS t, strlen(text) AS bytes FROM src)),
c AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, xor(4294967295::BIGINT, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
        lambda crc, x: xor(crc >> 8, list_reduce([xor(crc, x) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)) % 9 AS h
      FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id)),
r AS (SELECT c.conv_id, o.pos AS depth, t, bytes FROM c JOIN o ON o.conv_id = c.base AND o.pos <= h
      UNION ALL SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + o.pos - c.h, t, bytes FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h LEFT JOIN c b ON b.conv_id = c.base),
path AS (SELECT conv_id, depth, bytes, sha256(string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS p FROM r),
m AS (SELECT conv_id, 0 AS depth, 0 AS bytes, '' AS p FROM c UNION ALL SELECT * FROM path),
e AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS deep, lag(p) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM m),
node AS (SELECT depth, p, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (depth = deep), '') AS ends FROM e GROUP BY depth, p),
kids AS (SELECT depth - 1 AS depth, up AS p, count(*) AS k FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (depth, p)),
under AS (SELECT DISTINCT x.depth, x.p, y.depth AS d2, y.p AS p2 FROM m x JOIN m y ON x.conv_id = y.conv_id AND y.depth >= x.depth),
total AS (SELECT u.depth, u.p, count(*) FILTER (f.k = 0) AS leaves, sum((f.n - 1) * f.bytes) AS saved FROM under u JOIN full_node f ON f.depth = u.d2 AND f.p = u.p2 GROUP BY ALL)
SELECT f.conv_id, f.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, f.n AS n_convs, f.k AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_node f JOIN total USING (depth, p) LEFT JOIN full_node a ON a.depth = f.depth - 1 AND a.p = f.up
"""

ORACLES = {"op2_url_filter": URL_FILTER, "op6_exact_dedup": EXACT_DEDUP, "op7_chat_formatting": CHAT_FORMATTING, "op12_conversation_trie": CONVERSATION_TRIE, "op13_source_divergence": SOURCE_DIVERGENCE}
