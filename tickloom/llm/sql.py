"""DuckDB SQL for the results of the operators that SQL can state.

Each statement goes over the whole table, by plain grouping and joining.
"""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"
WORD_WINDOWS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS words FROM documents),
    g AS (SELECT doc_id, s, array_to_string(words[s : s + 49], ' ') AS body
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50)),
    f AS (SELECT body, min(doc_id) AS first FROM g GROUP BY body),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM (SELECT g.doc_id, g.s FROM g JOIN f USING (body) WHERE f.first < g.doc_id)),
    each_word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body FROM each_word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
        sha256(coalesce(k.body, '')) AS kept_sha256 FROM w LEFT JOIN kept k USING (doc_id)"""
NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS words FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS g
          FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id),
    least AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
    SELECT l.doc_id, coalesce(n.n, 0) AS n_shingles, l.root AS component_id, l.root = l.doc_id AS kept FROM least l LEFT JOIN n USING (doc_id)"""
BYTE_STRINGS = """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    g AS (SELECT doc_id, i, md5(array_slice(x, i, i + 199)) AS h FROM (SELECT doc_id, x, unnest(range(1, n - 198)) AS i FROM b WHERE n >= 200)),
    f AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
    hits AS (SELECT g.doc_id, g.i FROM g SEMI JOIN f USING (h)),
    marked AS (SELECT *, CASE WHEN i > 200 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM hits),
    grouped AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
    runs AS (SELECT doc_id, run, min(i) AS lo, max(i) + 199 AS hi FROM grouped GROUP BY 1, 2),
    sums AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo + 1) AS n_removed FROM runs GROUP BY doc_id),
    pieces AS (SELECT doc_id, hi + 1 AS a, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) - 1 AS z FROM runs
        UNION ALL SELECT doc_id, 1, min(lo) - 1 FROM runs GROUP BY doc_id),
    kept AS (SELECT b.doc_id, string_agg(hex(array_slice(b.x, p.a, coalesce(p.z, b.n))), '' ORDER BY p.a) AS body
        FROM pieces p JOIN b USING (doc_id) WHERE p.a <= coalesce(p.z, b.n) GROUP BY b.doc_id)
    SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed, coalesce(s.n_spans, 0) AS n_spans,
        CASE WHEN s.doc_id IS NULL THEN sha256(b.x) ELSE sha256(unhex(coalesce(k.body, ''))) END AS kept_sha256
    FROM b LEFT JOIN sums s USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
ARCHIVED_PAGES = """WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
    f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
    SELECT page_id, n AS payload_bytes, d.h AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN first <> page_id THEN first END AS refers_to FROM d LEFT JOIN f ON f.h = d.h AND d.n >= 100"""
# crc32 byte by byte and bit by bit, with the polynomial in reversed order.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
    lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
PREFIX_TRIE = f"""WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h
        FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list(struct_pack(h := h, n := n) ORDER BY turn NULLS FIRST, h) AS turns FROM t GROUP BY conv_id),
    parts AS (SELECT conv_id, turns, conv_id - conv_id % 100 AS head, {CRC32} % 6 AS h FROM own),
    r AS (SELECT p.conv_id, list_concat(coalesce(o.turns, [])[1 : p.h], p.turns[p.h + 1 :]) AS turns FROM parts p LEFT JOIN own o ON o.conv_id = p.head),
    k AS (SELECT conv_id, list_transform(turns, lambda x: x.h) AS hs, list_transform(turns, lambda x: x.n) AS ns FROM r),
    m AS (SELECT conv_id, hs, ns, unnest(range(0, len(hs) + 1)) AS d FROM k),
    nodes AS (SELECT hs[1 : d] AS path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(ns[d]), 0) AS chars,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(hs) = d), '') AS ends FROM m GROUP BY 1, 2),
    kids AS (SELECT path[1 : d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
    up AS (SELECT n.path[1 : a.d] AS path, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
        FROM nodes n LEFT JOIN kids k USING (path), LATERAL (SELECT unnest(range(0, n.d + 1)) AS d) a GROUP BY 1)
    SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, u.leaves AS n_leaves,
        CAST(u.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
    FROM nodes n JOIN up u USING (path) LEFT JOIN kids k USING (path) LEFT JOIN nodes p ON p.path = n.path[1 : n.d - 1] AND p.d = n.d - 1"""
