"""DuckDB SQL for the queries of this subpackage that SQL can express. For small tables: it compares by brute force."""

from __future__ import annotations

from . import rollup, rules

_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, (strlen(coalesce(text, '')))::BIGINT AS n FROM documents),
c AS (SELECT doc_id, n, b, substring(x, 2 * b + 1, 1198) AS y FROM (SELECT *, unnest(range(0, n - 99, 500)) AS b FROM d WHERE n >= 100)),
p AS (SELECT doc_id, b + o AS s, md5_number(substring(y, 2 * o + 1, 200)) AS w FROM (SELECT *, unnest(range(0, least(500, n - 99 - b))) AS o FROM c)),
g AS (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS r FROM p),
i AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS fresh FROM g WHERE r > 1),
j AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM i),
spans AS (SELECT doc_id, min(s) AS b, max(s) + 100 AS e FROM j GROUP BY doc_id, island),
cuts AS (SELECT doc_id, b, e FROM spans UNION ALL SELECT doc_id, n AS b, n AS e FROM d),
pieces AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b, e), 0) AS a FROM cuts),
kept AS (SELECT p.doc_id, string_agg(substring(d.x, 2 * a + 1, 2 * (b - a)), '' ORDER BY b, e) AS h FROM pieces p JOIN d USING (doc_id) GROUP BY p.doc_id),
sums AS (SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

OP10 = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, array_to_string(w[k:k + 9], ' ') AS s, least(len(w), 10) AS size FROM i),
sizes AS (SELECT DISTINCT size FROM windows),
p AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS k FROM words, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, p.k, p.size, item FROM p JOIN windows v ON v.size = p.size AND v.s = array_to_string(w[p.k:p.k + p.size - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT c)::BIGINT AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS c FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*)::BIGINT AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM words LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""


def _op9() -> str:
    excess = ", ".join(f"100 * (1000 * {a} // greatest({b}, 1)) // {rules.RULES[r]}" for r, (a, b) in rules.PARTS.items())
    term = f"exp(lgamma(good + 1.0) - lgamma(i + 1.0) - lgamma(good - i + 1.0) + i * ln({rules.RISK}) + (good - i) * ln(1.0 - {rules.RISK}))"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, 'null') AS stratum, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM s WHERE len(w) >= 5),
v AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, array_to_string(w[k:k + 4], ' ')) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT x)::BIGINT AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS x FROM v WHERE c > 1) GROUP BY doc_id),
c AS (SELECT s.doc_id, stratum, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper, len(regexp_extract_all(text, '!'))::BIGINT AS n_exclaims FROM s LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest({excess}) AS excess FROM c),
y AS (SELECT DISTINCT stratum, quality, text, excess FROM f JOIN labels USING (doc_id) WHERE quality IN (0, 1) AND NOT base_failed),
z AS (SELECT stratum, factor, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 1 AND excess > factor) AS good_lost, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality = 0 AND excess > factor) AS bad_lost
  FROM y, (SELECT unnest({list(rules.FACTORS)}) AS factor) GROUP BY ALL),
q AS (SELECT *, CASE WHEN good > 0 AND good_lost < good * {rules.RISK} THEN list_sum(list_transform(range(0, good_lost + 1), lambda i: {term})) ELSE 1 END <= {rules.DOUBT} / (SELECT count(DISTINCT stratum) FROM y) AS holds FROM z),
o AS (SELECT *, bool_and(holds) OVER (PARTITION BY stratum ORDER BY factor DESC) AS safe FROM q),
b AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY round(bad_lost / greatest(bad, 1) - {rules.COST} * good_lost / good, 9) DESC, factor DESC) AS place FROM o WHERE safe),
x AS (SELECT f.doc_id FROM f JOIN b ON b.stratum = f.stratum AND place = 1 AND f.excess > b.factor)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM x) AS kept FROM f
"""

#: Digits of base32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP11 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x, sha256(coalesce(html, '')) AS y FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(0, 40), lambda k: printf('%04d', bin(strpos('0123456789abcdef', substring(x, k + 1, 1)) - 1)::INT)), '') AS bits FROM p),
f AS (SELECT *, array_to_string(list_transform(range(0, 160, 5), lambda k: substring('{_BASE32}', 1 + list_reduce(list_transform(range(1, 6), lambda j: substring(bits, k + j, 1)::INT), lambda a, c: 2 * a + c), 1)), '') AS payload_digest,
  first_value(page_id) OVER w AS f, row_number() OVER w AS r FROM b WINDOW w AS (PARTITION BY payload_bytes, y ORDER BY page_id NULLS FIRST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN r > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN r > 1 THEN f END AS refers_to, true AS intact FROM f
"""

#: The table t of the CRC-32 by bytes (reflected polynomial 0xEDB88320).
_CRC_TABLE = "crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)) + z) ORDER BY n) AS t FROM (SELECT unnest(range(0, 256))::BIGINT AS n))"


def _crc(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes."""
    byte = f"('0x' || substring(hex(encode({text})), 2 * k + 1, 2))::BIGINT"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, strlen({text})), lambda k: {byte})), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"


def _tree(name: str, leaves: str, levels: int) -> str:
    """CTEs: the nodes (g, i, h, m) of each level, m of them in group g, their siblings by level, and the root of each group."""
    parts = [f"{name}0 AS (SELECT g, i, h, m FROM {leaves})"]
    for k in range(levels):
        parts.append(f"{name}{k + 1} AS (SELECT g, i // 3 AS i, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(m) + 2) // 3 AS m FROM {name}{k} GROUP BY g, i // 3)")
    side = lambda rows: f"coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 3 ORDER BY i ROWS BETWEEN {rows}), '')"
    step = f"SELECT g, i, {{k}} AS level, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} || ',' || {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS step FROM {name}{{k}} WHERE m > 1"
    parts.append(f"{name}_steps AS ({' UNION ALL '.join(step.format(k=k) for k in range(levels))})")
    return ", ".join(parts)


def _op12(levels: int = 12) -> str:
    """For groups of up to 3 to the power of `levels` rows."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    head = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    return f"""
WITH {_CRC_TABLE},
e AS (SELECT doc_id, source, {head} AS head, text, CASE WHEN {_crc("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents, crc),
d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, sha256(head || {field("text")}) AS h, sha256(head || {field("now")}) AS now FROM e),
a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM d),
{_tree("a", "a", levels)},
b AS (SELECT 0 AS g, g AS i, h, count(*) OVER () AS m FROM a{levels}),
{_tree("b", "b", levels)},
s AS (SELECT a.doc_id, a.g, a.i, 0 AS tree, level, step FROM a JOIN a_steps s ON s.g = a.g AND s.i = a.i // (3 ** level)::BIGINT UNION ALL SELECT a.doc_id, a.g, a.i, 1, level, step FROM a JOIN b_steps s ON s.i = a.g // (3 ** level)::BIGINT),
p AS (SELECT g, i, list(step ORDER BY tree, level) AS steps FROM s GROUP BY g, i),
r AS (SELECT a.doc_id, a.h AS leaf, t.h AS subroot, root.h AS root, sha256(replace(array_to_string(coalesce(steps, []), ''), ',', '')) AS proof_sha256,
  list_reduce(list_prepend(now, coalesce(steps, [])), lambda n, s: sha256(split_part(s, ',', 1) || n || split_part(s, ',', 2))) AS folded_root
  FROM a JOIN a{levels} t USING (g) CROSS JOIN b{levels} root LEFT JOIN p ON p.g = a.g AND p.i = a.i)
SELECT *, folded_root = root AS verified FROM r
"""


OP13 = rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), {_ASCII}) AS r FROM documents),
c AS (SELECT doc_id, r, count(*) AS c, coalesce(doc_id::VARCHAR, '') || ':' || r AS name FROM r WHERE length(r) >= 6 GROUP BY doc_id, r),
h AS (SELECT r, c, {_crc("name")} AS h FROM c, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN left(r, h % length(r)) || substring(r, h % length(r) + 2) ELSE r END AS word, sum(c)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5),
v AS (SELECT word, n, i, left(word, i) || substring(word, i + 2) AS s FROM (SELECT *, unnest(range(0, length(word))) AS i FROM w)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM v a JOIN v b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
  UNION SELECT v.word, v.n, w.word, w.n FROM v JOIN w ON v.s = w.word UNION SELECT w.word, w.n, v.word, v.n FROM v JOIN w ON v.s = w.word),
best AS (SELECT word, count(*)::BIGINT AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)),
path AS (SELECT word, word AS at FROM f UNION ALL SELECT path.word, f.form FROM path JOIN f ON f.word = path.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, path.at AS root FROM f JOIN path USING (word) JOIN f last ON last.word = path.at WHERE last.form IS NULL
"""


ORACLE_SQL = {
    "op4_token_counts": rollup.ORACLE_SQL,
    "op6_suffix_dedup": OP6,
    "op9_rules": _op9(),
    "op10_decontamination": OP10,
    "op11_warc": OP11,
    "op12_merkle": _op12(),
    "op13_variants": OP13,
}
