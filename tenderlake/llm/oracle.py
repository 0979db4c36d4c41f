"""DuckDB SQL of the corpus queries that SQL can express, in other ways than the operators work."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, between: str) -> str:
    small = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    return f"list_filter(regexp_split_to_array({small}, '[{between}]+'), lambda x: x <> '')"


DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_words('text', r'\x00-\x2F\x3A-\x60\x7B-\x7F')} AS w FROM documents),
b AS (SELECT item_id, {_words('text', r'\x00-\x2F\x3A-\x60\x7B-\x7F')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n,
    unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS win
  FROM b WHERE len(w) > 0),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'win': array_to_string(w[i:i + n - 1], ' ')}})) AS x
  FROM d JOIN (SELECT DISTINCT n FROM bw) ON len(w) >= n),
hit AS (SELECT DISTINCT doc_id, x.i AS i, dw.n AS n, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.win = x.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS c, string_agg(item, ',' ORDER BY item) AS l
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.c, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.c, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.l, '')) AS items_sha256, coalesce(covered.c, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

# Segments level by level, as a chain of the same steps.
_LEVEL = """
c{k} AS (SELECT host, t{j} AS t, s[{k}] AS seg, sum(n) AS own FROM p{j} WHERE len(s) >= {k} GROUP BY ALL),
f{k} AS (SELECT *, own * 50 >= sum(own) OVER (PARTITION BY host, t) AND NOT regexp_matches(seg, '[0-9]') AS fixed FROM c{k}),
p{k} AS (SELECT p{j}.*, t{j} || CASE WHEN len(s) < {k} THEN '' WHEN f{k}.fixed THEN '/' || s[{k}] ELSE '/*' END AS t{k}
  FROM p{j} LEFT JOIN f{k} ON f{k}.host = p{j}.host AND f{k}.t = t{j} AND f{k}.seg = s[{k}]),"""

URL_FILTERS = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
names AS (SELECT DISTINCT host, path FROM u),
fit AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS ruled FROM names
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2),
r AS (SELECT u.*, rule, ruled FROM u LEFT JOIN fit USING (host, path)),
p0 AS (SELECT host, path, count(*) AS n, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad,
    list_filter(string_split(path, '/'), lambda x: x <> '') AS s, '' AS t0 FROM r GROUP BY host, path),
{"".join(_LEVEL.format(k=k, j=k - 1) for k in (1, 2, 3))}
t AS (SELECT host, path, n, good, bad, t3 || CASE WHEN len(s) > 3 THEN '/**' ELSE '' END AS template FROM p3),
o AS (SELECT host, template, regexp_replace(template, '^/[^/]+', '/*') AS branch, sum(good) AS g, sum(bad) AS b, sum(n) AS c FROM t GROUP BY ALL),
q AS (SELECT *, sum(c) OVER (PARTITION BY host, branch) AS ac, sum(g) OVER (PARTITION BY host, branch) AS ag, sum(b) OVER (PARTITION BY host, branch) AS ab,
    count(*) OVER (PARTITION BY host, branch) AS branches FROM o),
z AS (SELECT *, CASE WHEN branches > 1 AND ag + ab > 0 AND g + b > 0 THEN abs(CAST(g AS DOUBLE) / (g + b) - CAST(ag AS DOUBLE) / (ag + ab))
    <= 1.96 * sqrt(CAST(ag AS DOUBLE) / (ag + ab) * (1 - CAST(ag AS DOUBLE) / (ag + ab)) / (g + b)) WHEN branches > 1 AND ag + ab > 0 THEN 2 * c * branches >= ac AND c * branches <= 2 * ac ELSE false END AS alike FROM q),
m AS (SELECT *, CASE WHEN alike THEN branch ELSE template END AS merged FROM z),
v AS (SELECT host, template, merged, (sum(g) OVER w + 2.5::DOUBLE) / (sum(g) OVER w + sum(b) OVER w + 5) < 0.25 AS blocked
  FROM m WINDOW w AS (PARTITION BY host, merged, alike))
SELECT page_id, r.host, r.path, rule, coalesce(ruled, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, merged AS template
FROM r JOIN t ON t.host = r.host AND t.path = r.path JOIN v ON v.host = t.host AND v.template = t.template"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(0, length(h) // 2 - 49), lambda i: {'i': i, 's': substr(h, 2 * i + 1, 100)})) AS x FROM d WHERE length(h) >= 100),
f AS (SELECT x.s AS s, min(doc_id) AS first FROM w GROUP BY 1),
g AS (SELECT DISTINCT doc_id, x.i AS i FROM w JOIN f ON f.s = x.s WHERE doc_id > first),
l AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM g),
k AS (SELECT doc_id, sum(least(50, coalesce(after - i, 50))) AS removed, count(*) FILTER (before IS NULL OR i > before + 50) AS spans,
    string_agg(substr(h, 2 * coalesce(before + 50, 0) + 1, 2 * (i - coalesce(before + 50, 0))), '' ORDER BY i) FILTER (before IS NULL OR i > before + 50) AS head,
    max(i) + 50 AS tail FROM l JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text', r'\x20\x09-\x0D')} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
x AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n, unnest(g) AS v FROM s),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.v = b.v AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other),
c AS (SELECT doc_id, min(other) AS component FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM s LEFT JOIN c USING (doc_id)"""

# Rounds as a chain of the same steps: a<k> assigns the parts, c<k> holds the entries. The distance and the index in one number order both.
_ASSIGNED = """
a{k} AS MATERIALIZED (SELECT p.q, p.vec_id, p.label, any_value(p.x) AS x, min(CAST(list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x) AS BIGINT) * 256 + c.e) AS near
  FROM p JOIN c{k} c ON c.q = p.q GROUP BY p.q, p.vec_id, p.label),"""
_MOVED = """
m{k} AS (SELECT q, near % 256 AS e, i, floor(sum(x[i]) / count(*)) AS v FROM a{k}, range(1, {width}) r(i) WHERE i <= len(x) GROUP BY ALL),
c{next} AS MATERIALIZED (SELECT c.q, c.e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT q, e, list(v ORDER BY i) AS x FROM m{k} GROUP BY ALL) m ON m.q = c.q AND m.e = c.e),"""

VECTOR_CODES = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, q, v[1 + q * len(v) // 4:(q + 1) * len(v) // 4] AS x FROM k, range(4) t(q)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 256),
c0 AS MATERIALIZED (SELECT q, e, x FROM p JOIN s USING (vec_id)),
{"".join(_ASSIGNED.format(k=k) + _MOVED.format(k=k, next=k + 1, width=4096) for k in range(4))}
{_ASSIGNED.format(k=4)}
d AS (SELECT vec_id, label, string_agg(format('{{:02x}}', near % 256), '' ORDER BY q) AS code, CAST(sum(near // 256) AS BIGINT) AS error FROM a4 GROUP BY vec_id, label),
b AS (SELECT sha256(string_agg(CAST(CAST(x[i] AS BIGINT) AS VARCHAR), ',' ORDER BY q, e, i)) AS h FROM c4, range(1, 4096) r(i) WHERE i <= len(x))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM b) AS codebooks_sha256 FROM d"""

# CRC-32 by bits: a number from 0 is a byte to add, -1 a shift.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({x}, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, o: CASE WHEN o >= 0 THEN xor(s, o) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END), 4294967295)"""

CONVERSATION_TRIE = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, CAST({_CRC.format(x="CAST(conv_id AS VARCHAR)")} AS BIGINT) % 4 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
l AS (SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY own, pos) AS marks,
    list(len(list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda x: x <> '')) ORDER BY own, pos) AS words FROM r GROUP BY conv_id),
f AS (SELECT c.conv_id, coalesce(marks, []) AS marks, coalesce(words, []) AS words FROM c LEFT JOIN l USING (conv_id)),
g AS (SELECT conv_id, d, len(marks) = d AS ends, array_to_string(marks[1:d], '') AS key, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words
  FROM f, LATERAL (SELECT unnest(range(0, len(marks) + 1)) AS d)),
n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM g GROUP BY key, d),
k AS (SELECT n.*, up.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.key[1:length(n.key)] = n.key) AS n_children
  FROM n LEFT JOIN n up ON up.d = n.d - 1 AND up.key = n.key[1:length(n.key) - 32])
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, k.parent_conv_id, CAST(k.n_convs AS BIGINT) AS n_convs, CAST(k.n_children AS BIGINT) AS n_children,
  CAST(count(*) FILTER (x.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((x.n_convs - 1) * x.words) AS BIGINT) AS saved_tokens, sha256(k.ids) AS ends_sha256
FROM k JOIN k x ON x.d >= k.d AND x.key[1:length(k.key)] = k.key GROUP BY k.conv_id, k.d, k.parent_conv_id, k.n_convs, k.n_children, k.ids"""

QUERIES = {
    "op2_decontamination": DECONTAMINATION,
    "op4_url_filters": URL_FILTERS,
    "op6_suffix_dedup": SUFFIX_DEDUP,
    "op10_minhash_dedup": NEAR_DUPLICATES,
    "op11_vector_codes": VECTOR_CODES,
    "op12_conversation_trie": CONVERSATION_TRIE,
}
