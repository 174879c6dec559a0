"""The queries that SQL can express, as DuckDB SQL. Scores that are learned, random rounding, sampled splitters and
approximate search are tested against brute force instead."""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PARTENUM_JOIN = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), reach(x, y) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.y) AS component_id
FROM documents JOIN reach ON reach.x = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

DOUBLING_DEDUP = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, p, array_to_string(list_slice(w, p, p + 34), ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)
), again AS (
    SELECT g FROM windows GROUP BY g HAVING count(*) > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS place FROM windows JOIN again USING (g)
), w AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, len(d.w) AS n_words, len(d.w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

WARC_BUNDLES = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS h,
        min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
    FROM pages
)
SELECT page_id, size::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""

_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE_INDEX = rf"""
WITH d AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_ITEM_WORDS}') AS w FROM documents
), items AS (
    SELECT item_id, w, least(10, len(w)) AS size
    FROM (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_ITEM_WORDS}') AS w FROM benchmark) WHERE len(w) > 0
), wanted AS (
    SELECT DISTINCT item_id, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM items)
), windows AS (
    SELECT doc_id, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS g
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
          FROM d, (SELECT DISTINCT size FROM wanted) WHERE len(w) >= size)
), hits AS (
    SELECT doc_id, item_id, p, size FROM windows JOIN wanted USING (size, g)
), places AS (
    SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS place FROM hits) GROUP BY doc_id
), listed AS (
    SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(listed.n, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

_PARTS = f"""
    SELECT page_id, {_LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")} AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
"""


def wildcard_urls(rules: tuple[tuple[str, str, str], ...]) -> str:
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in rules)
    return f"""
WITH u AS ({_PARTS}), rules(host, path, verdict) AS (VALUES {values}), fits AS (
    SELECT page_id, rules.host || rules.path AS rule, rules.verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rules.host || rules.path) DESC) AS place
    FROM u JOIN rules ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (page_id)
"""


def _sized(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_sized, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: Unsigned CRC-32 of an integer's decimal text, by the polynomial's bit steps over its bytes.
_CRC = """
CREATE_CRC AS (
    SELECT k, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(k::VARCHAR)), lambda i: ascii(substr(k::VARCHAR, i + 1, 1))::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS c
    FROM KEYS
)
"""


def _crc(name: str, keys: str) -> str:
    """A table (k, crc) of the keys."""
    steps = _CRC.replace("CREATE_CRC", f"{name}_raw").replace("KEYS", keys)
    return f"{steps}, {name} AS (SELECT k, xor(c, 4294967295::BIGINT) AS crc FROM {name}_raw)"


MERKLE_MANIFEST = f"""
WITH RECURSIVE ids AS (
    SELECT DISTINCT doc_id AS k FROM documents WHERE doc_id IS NOT NULL
), {_crc("crcs", "ids")}, leaves AS (
    SELECT doc_id, coalesce('.' || lang, '') AS g, {_leaf("text")} AS leaf,
        CASE WHEN crc % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS claimed
    FROM documents LEFT JOIN crcs ON k = doc_id
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves
), nodes(g, level, pos, n, h) AS (
    SELECT g, 0::BIGINT, pos, n, leaf FROM placed
    UNION ALL
    SELECT g, level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY g, level, pos // 8
), tops AS (
    SELECT g, max(level) AS levels, max_by(h, level) AS subroot FROM nodes GROUP BY g
), upper(level, pos, n, h) AS (
    SELECT 0::BIGINT, row_number() OVER (ORDER BY g) - 1, count(*) OVER (), subroot FROM tops
    UNION ALL
    SELECT level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 8
), every AS (
    SELECT g, level, pos, n, h FROM nodes WHERE n > 1
    UNION ALL
    SELECT t.g, t.levels + u.level, u.pos, u.n, u.h FROM tops t, upper u WHERE u.n > 1
), starts AS (
    SELECT g, levels, row_number() OVER (ORDER BY g) - 1 AS place, subroot FROM tops
), steps AS (
    SELECT e.g, e.level, e.pos, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < e.pos), '') AS l,
        coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > e.pos), '') AS r
    FROM every e JOIN every s ON s.g = e.g AND s.level = e.level AND s.pos // 8 = e.pos // 8 GROUP BY ALL
), paths AS (
    SELECT p.doc_id, p.leaf, p.g, p.pos AS own, s.level, s.l, s.r
    FROM placed p JOIN starts USING (g) JOIN steps s
        ON s.g = p.g AND s.pos = CASE WHEN s.level < levels THEN p.pos >> (3 * s.level) ELSE place >> (3 * (s.level - levels)) END
), proofs AS (
    SELECT g, own, list(struct_pack(l := l, r := r) ORDER BY level) AS proof FROM paths GROUP BY ALL
), root AS (
    SELECT max_by(h, level) AS root FROM upper
), done AS (
    SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(proof, lambda x: x.l || x.r), ''), '')) AS proof_sha256,
        list_reduce(list_prepend(struct_pack(l := claimed, r := ''), coalesce(proof, [])), lambda a, x: struct_pack(l := sha256(x.l || a.l || x.r), r := '')).l AS folded_root
    FROM placed p JOIN starts USING (g) LEFT JOIN proofs q ON q.g = p.g AND q.own = p.pos CROSS JOIN root
)
SELECT *, folded_root = root AS verified FROM done
"""

PREFIX_TRIE = f"""
WITH c AS (
    SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS own FROM conversations
    WHERE conv_id IS NOT NULL GROUP BY conv_id
), ids AS (
    SELECT conv_id AS k FROM c
), {_crc("crcs", "ids")}, rebuilt AS (
    SELECT c.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, crc % 9), list_slice(c.own, crc % 9 + 1, len(c.own))) AS t
    FROM c JOIN crcs ON k = c.conv_id LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5
), member AS (
    SELECT conv_id, d, list_slice(t, 1, d) AS path, len(t) AS size FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT path, d, min(conv_id) AS first, count(*) AS n,
        CASE WHEN d > 0 THEN strlen(path[d].text) ELSE 0 END * (count(*) - 1) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends
    FROM member GROUP BY path, d
), children AS (
    SELECT list_slice(path, 1, d - 1) AS path, count(*) AS children FROM nodes WHERE d > 0 GROUP BY ALL
), full_nodes AS (
    SELECT nodes.*, coalesce(children, 0) AS children FROM nodes LEFT JOIN children USING (path)
), sums AS (
    SELECT a.path, count(*) FILTER (u.children = 0) AS leaves, sum(u.saved) AS saved
    FROM full_nodes a JOIN full_nodes u ON u.d >= a.d AND list_slice(u.path, 1, a.d) = a.path GROUP BY a.path
)
SELECT a.first AS conv_id, a.d::BIGINT AS depth, p.first AS parent_conv_id, a.n AS n_convs, a.children AS n_children, leaves AS n_leaves,
    sums.saved::BIGINT AS saved_tokens, a.ends AS ends_sha256
FROM full_nodes a JOIN sums USING (path) LEFT JOIN nodes p ON a.d > 0 AND p.path = list_slice(a.path, 1, a.d - 1)
"""
