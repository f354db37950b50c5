"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .quality import STOP_WORDS

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t-\\r]+'), lambda x: x <> '')"

OP1 = f"""WITH n AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256 FROM n WINDOW g AS (PARTITION BY text_sha256)"""

OP4 = f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM w WHERE len(w) >= 50),
g AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM s),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first_id FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM f WHERE first_id < doc_id),
l AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(l.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)"""

OP8 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.seen FROM r JOIN e ON r.doc_id = e.a AND r.seen < e.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.seen) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, len(s.s)"""

#: CRC-32 by bytes and jump consistent hashing in 64-bit arithmetic, step by step.
OP2 = """WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS n, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT n, doc_id, CAST(length(h) // 2 + 8 AS BIGINT) AS size, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM d),
c AS (SELECT n, doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) AS text_crc32 FROM b, crc_table),
k0 AS (SELECT DISTINCT doc_id, CAST((CAST(coalesce(doc_id, -9223372036854775808) AS HUGEINT) + 18446744073709551616 + 11400714819323198485) % 18446744073709551616 AS UBIGINT) AS x FROM c),
k1 AS (SELECT doc_id, CAST(CAST(xor(x, x >> 30) AS UHUGEINT) * CAST(13787848793156543929 AS UHUGEINT) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT) AS x FROM k0),
k2 AS (SELECT doc_id, CAST(CAST(xor(x, x >> 27) AS UHUGEINT) * CAST(10723151780598845931 AS UHUGEINT) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT) AS x FROM k1),
j(doc_id, shards, state, here, ahead) AS (
 SELECT doc_id, shards, xor(x, x >> 31), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM k2, (VALUES (24), (25)) s(shards)
 UNION ALL
 SELECT doc_id, shards, st, ahead, CAST(floor((ahead + 1) * (2147483648.0::DOUBLE / CAST((st >> 33) + 1 AS DOUBLE))) AS BIGINT)
 FROM (SELECT doc_id, shards, ahead, CAST((CAST(state AS UHUGEINT) * CAST(2862933555777941757 AS UHUGEINT) + CAST(1 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT) AS st FROM j WHERE ahead < shards)),
p AS (SELECT doc_id, max(here) FILTER (shards = 24) AS shard, max(here) FILTER (shards = 25) AS grown_shard FROM j GROUP BY doc_id)
SELECT c.doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
 row_number() OVER (PARTITION BY shard ORDER BY c.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM c JOIN p ON c.doc_id IS NOT DISTINCT FROM p.doc_id"""

_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP6 = f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_WORDS.format("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS l FROM t),
g AS (SELECT r, unnest(list_transform(range(1, len(w) - 6), lambda p: {{'p': p, 's': array_to_string(w[p:p + 7], ' ')}})) AS g FROM w WHERE len(w) >= 8),
h AS (SELECT r, g.p AS p, count(*) OVER (PARTITION BY r, g.s) AS n FROM g),
q AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS i FROM h WHERE n > 1) GROUP BY r),
c AS (SELECT w.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words,
 len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({_LIST}))) AS n_stop, len(list_filter(w, lambda x: ends_with(x, '!!'))) AS n_marks
 FROM w LEFT JOIN q USING (r)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 100 * word_chars < 200 * n_words OR 100 * word_chars > 1200 * n_words OR 100 * n_symbols > 40 * n_words OR 100 * n_dup_lines > 40 * n_lines
 OR 100 * n_stop < n_words OR 100 * n_marks > 40 * n_words) AS kept FROM v"""

#: Levels of all trees by recursion, the crown of subroots as group '|'; a document's siblings are the others of its runs.
_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_LEVELS = """{name}(g, k, i, n, d) AS (SELECT {base} UNION ALL
 SELECT g, k + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, k, i // 3, n)"""
#: CRC-32 of decimal ids is not in SQL's library; its lowest bit comes from the bits of the bytes.
OP11 = f"""WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
b AS (SELECT doc_id, source, lang, n_chars, text, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)) AS bytes FROM documents),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) % 2 = 0 AS half FROM b, crc_table),
l AS (SELECT doc_id, coalesce('=' || source, '') AS g, sha256({_LEAF}) AS leaf, CASE WHEN half THEN sha256({_LEAF.replace("(text AS", "(replace(text, chr(10), '') AS")}) ELSE sha256({_LEAF}) END AS checked FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
{_LEVELS.format(name="lv", base="g, 0, i, n, leaf FROM p")},
top AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
{_LEVELS.format(name="cr", base="'|', 0, i, n, d FROM top")},
heights AS (SELECT g, max(k) AS h FROM lv GROUP BY g),
steps AS (SELECT p.g, p.i, 0 AS part, v.k, v.i AS pos, v.i // 3 AS up, v.n FROM p JOIN lv v ON v.g = p.g AND v.i = p.i // CAST(pow(3, v.k) AS BIGINT) AND v.n > 1),
own AS (SELECT s.g, s.i, s.part, s.k, coalesce(string_agg(o.d, '' ORDER BY o.i) FILTER (o.i < s.pos), '') AS before, coalesce(string_agg(o.d, '' ORDER BY o.i) FILTER (o.i > s.pos), '') AS after
 FROM steps s JOIN lv o ON o.g = s.g AND o.k = s.k AND o.i // 3 = s.up GROUP BY ALL),
crown AS (SELECT top.g, 1 AS part, v.k, coalesce(string_agg(o.d, '' ORDER BY o.i) FILTER (o.i < v.i), '') AS before, coalesce(string_agg(o.d, '' ORDER BY o.i) FILTER (o.i > v.i), '') AS after
 FROM top JOIN cr v ON v.i = top.i // CAST(pow(3, v.k) AS BIGINT) AND v.n > 1 JOIN cr o ON o.k = v.k AND o.i // 3 = v.i // 3 GROUP BY ALL),
path AS (SELECT g, i, list(before || '|' || after ORDER BY part, k) AS steps, string_agg(before || after, '' ORDER BY part, k) AS siblings
 FROM (SELECT g, i, part, k, before, after FROM own UNION ALL SELECT p.g, p.i, c.part, c.k, c.before, c.after FROM p JOIN crown c ON c.g = p.g) GROUP BY g, i),
f AS (SELECT p.doc_id, p.leaf, top.d AS subroot, r.d AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
 list_reduce(list_prepend(p.checked, coalesce(steps, [])), lambda c, s: sha256(split_part(s, '|', 1) || c || split_part(s, '|', 2))) AS folded_root
 FROM p JOIN top ON top.g = p.g JOIN cr r ON r.n = 1 LEFT JOIN path ON path.g = p.g AND path.i = p.i)
SELECT *, folded_root = root AS verified FROM f"""

#: Every group has every kept term here, absent or not, and every pair of sources is compared term by term.
_SHARE = "(1 + CAST((1000000000::HUGEINT * ({0} + 2)) // ({1} + 2 * {2}) AS BIGINT))"
OP13 = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT d.lang, source, coalesce(v, 0) AS v FROM d LEFT JOIN v USING (lang)),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
a AS (SELECT g.lang, g.source, k.term, g.v, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n) OVER (PARTITION BY lang) AS lang_total, sum(n) OVER (PARTITION BY lang, term) AS lang_n FROM a),
p AS (SELECT *, {_SHARE.format("n", "total", "v")} AS p, {_SHARE.format("lang_n", "lang_total", "v")} AS q FROM s),
f AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
o AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
 LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
 UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10"""

OP12 = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT r, vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
m AS (SELECT a, count(*) AS n FROM l GROUP BY a),
w(r, seen) AS (SELECT r, r FROM v UNION SELECT l.b, w.seen FROM w JOIN l ON w.r = l.a),
c AS (SELECT w.r, min(s.vec_id) AS component_id FROM w JOIN v s ON w.seen = s.r GROUP BY w.r)
SELECT v.vec_id, coalesce(m.n, 0) AS n_links, c.component_id, v.vec_id IS NOT DISTINCT FROM c.component_id AS kept FROM v JOIN c USING (r) LEFT JOIN m ON m.a = v.r"""

SQL = {"op12_vectors": OP12, "op13_divergence": OP13, "op11_merkle": OP11, "op2_sharding": OP2, "op6_quality": OP6, "op1_exact_dedup": OP1, "op4_substring_dedup": OP4, "op8_jaccard": OP8}
