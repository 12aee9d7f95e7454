"""SQL of the corpus queries, over the same tables."""

URLS = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT row_number() OVER () AS row_id, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), urls AS (
  SELECT row_id, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT row_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY row_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS rn
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fits ON urls.row_id = fits.row_id AND rn = 1
"""

COPIES = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

#: Shingles as strings; only pairs that share one are counted.
NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 2, 2))) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) = sa.n AND sa.n = sb.n AS same FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes sa ON sa.doc_id = a.doc_id JOIN sizes sb ON sb.doc_id = b.doc_id
  WHERE 100 * sa.n >= 85 * sb.n AND 100 * sb.n >= 85 * sa.n
  GROUP BY a.doc_id, b.doc_id, sa.n, sb.n HAVING 100 * count(*) >= 85 * (sa.n + sb.n - count(*))
), sets AS (
  SELECT doc_id, least(doc_id, coalesce(min(y) FILTER (same), doc_id)) AS set_id FROM documents LEFT JOIN links ON x = doc_id GROUP BY doc_id
), degrees AS (
  SELECT x, count(DISTINCT set_id) AS n_links FROM links JOIN sets ON sets.doc_id = y WHERE NOT same GROUP BY x
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach.y) AS component_id, coalesce(any_value(n_links), 0) AS n_links
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN degrees ON degrees.x = d.doc_id JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id
"""

QUALITY = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM docs
), wins AS (
  SELECT row_id, i, array_to_string(w[i : i + 4], ' ') AS s FROM words, unnest(range(1, len(w) - 3)) AS r(i) WHERE len(w) >= 5
), twice AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, s) AS n FROM wins) WHERE n >= 2
), repeats AS (
  SELECT row_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS o(k) GROUP BY row_id
), base AS (
  SELECT words.row_id, doc_id, host, text, l, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM words LEFT JOIN repeats ON repeats.row_id = words.row_id
), lines AS (
  SELECT row_id, doc_id, host, text, lower(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS line,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT row_id, doc_id, host, text, unnest(l) AS line FROM base)
), frequent AS (
  SELECT host, line FROM lines GROUP BY host, line HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), text)) >= 50
), removed AS (
  SELECT row_id, sum(n) AS n FROM lines JOIN frequent ON frequent.host = lines.host AND frequent.line = lines.line GROUP BY row_id
), failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * (n_words - least(n_words, coalesce(n, 0))) >= 30 * n_words AS kept, CAST(coalesce(n, 0) AS BIGINT) AS removed_words
FROM failed LEFT JOIN removed ON removed.row_id = failed.row_id
"""

#: Every node by its whole prefix, as text; what is below a node is counted through its members.
TRIE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 4 AS h FROM t
), turns AS (
  SELECT crc.conv_id AS c, pos, role, text, words FROM crc JOIN t ON t.conv_id = crc.conv_id AND pos > h
  UNION ALL SELECT crc.conv_id, pos, role, text, words FROM crc JOIN t ON t.conv_id = base AND pos <= h
), prefixes AS (
  SELECT c, row_number() OVER w AS d, words, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS p FROM turns WINDOW w AS (PARTITION BY c ORDER BY pos)
), placed AS (
  SELECT c, d, words, sha256(p) AS p FROM prefixes UNION ALL SELECT conv_id, 0, 0, sha256('') FROM crc
), steps AS (
  SELECT *, lag(p) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS is_end FROM placed
), nodes AS (
  SELECT p, any_value(d) AS d, any_value(words) AS words, any_value(up) AS up, min(c) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (is_end), '')) AS ends FROM steps GROUP BY p
), children AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT steps.p, sum((nodes.n - 1) * nodes.words) AS saved, count(*) FILTER (nodes.p NOT IN (SELECT up FROM children)) AS leaves
  FROM nodes JOIN steps ON steps.c = nodes.conv_id AND steps.d <= nodes.d GROUP BY steps.p
)
SELECT nodes.conv_id, nodes.d AS depth, above.conv_id AS parent_conv_id, nodes.n AS n_convs, CAST(coalesce(children.n, 0) AS BIGINT) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, nodes.ends AS ends_sha256
FROM nodes LEFT JOIN nodes above ON above.p = nodes.up LEFT JOIN children ON children.up = nodes.p JOIN below ON below.p = nodes.p
"""

ORACLES = {"op2_url_filters": URLS, "op3_ngram_jaccard_join": NEAR, "op5_quality_rules": QUALITY, "op7_exact_dedup": COPIES, "op12_conversation_prefix_trie": TRIE}
