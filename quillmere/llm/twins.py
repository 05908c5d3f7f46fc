"""DuckDB SQL for the queries that SQL can express. It compares all with all, so it is for small tables."""

REACH = """reach(id, c) AS (SELECT id, id FROM nodes UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.id)"""

OP1 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
nodes AS (SELECT vec_id AS id FROM v), {REACH},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.id"""

OP5 = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[1 + place % 3] AS w, 2.0::DOUBLE * total AS cap, 1.5::DOUBLE * sum(total) OVER () AS budget FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, place) AS k, sum(cap) OVER (ORDER BY cap / w, place) - cap AS held, sum(w) OVER () - sum(w) OVER (ORDER BY cap / w, place) + w AS free FROM w),
r AS (SELECT (budget - held) / free AS rate FROM o WHERE w * ((budget - held) / free) <= cap ORDER BY k LIMIT 1),
t AS (SELECT source, total, least(cap, w * rate) AS target FROM w, r),
p AS (SELECT source, total, target, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS whole, target - CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END * total AS rest FROM t),
g AS (SELECT source, h, sum(size) AS g FROM d GROUP BY source, h), c AS (SELECT source, h, g, sum(g) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
i AS (SELECT c.source, c.h, rest > 0 AND (upto <= rest OR (upto - g <= rest AND g - (rest - (upto - g)) < rest - (upto - g))) AS more FROM c JOIN p ON p.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, total AS source_size, target, CAST(size * (whole + CASE WHEN more THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source JOIN i ON i.source IS NOT DISTINCT FROM d.source AND i.h = d.h"""

_KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1),
    ("access", "AKIA[A-Z0-9]{12,}", 0),
    ("hex", "[0-9a-f]{32,}", 0),
    ("opaque", "[A-Za-z0-9+/_=-]{24,}", 0),
)
_FOUND = " UNION ALL ".join(
    f"SELECT row, owner, repo, {k} AS kind, unnest(range(1, len(m) + 1)) AS i, m, v, s FROM (SELECT row, owner, repo, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {g}) AS v, string_split_regex(t, '{p}') AS s FROM d)" for k, (_, p, g) in enumerate(_KINDS)
)
OP6 = rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, coalesce(source, '') || chr(31) || coalesce(lang, '') AS repo, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND}),
p AS (SELECT row, owner, repo, kind, v[i] AS value, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start, length(m[i]) AS n FROM f),
q AS (SELECT *, start + n AS stop FROM p WHERE kind IN (1, 2) OR (kind = 0 AND length(value) >= 8) OR (kind = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]'))),
e AS (SELECT * FROM q WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM q b WHERE b.row = q.row AND b.kind < 3 AND b.start < q.stop AND q.start < b.stop)),
o AS (SELECT value, count(DISTINCT owner) <= 1 AND count(DISTINCT repo) <= 2 AS live FROM e GROUP BY value),
x AS (SELECT e.*, live, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS name FROM e JOIN o USING (value)),
a AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(name, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(name, ',' ORDER BY start, kind) FILTER (WHERE kind < 3 OR live) AS spans, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_shared FROM x GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared FROM d LEFT JOIN a USING (row)"""

OP10 = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM g GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id WHERE least(p.n, q.n) >= 0.8 * greatest(p.n, q.n) GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING count(*) >= 0.8 * (p.n + q.n - count(*))),
nodes AS (SELECT doc_id AS id FROM documents), {REACH},
c AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id), m AS (SELECT a, count(*) AS m FROM links GROUP BY a), k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM n)
SELECT id AS doc_id, coalesce(class_id, id) AS class_id, coalesce(m, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN m ON m.a = c.id LEFT JOIN k ON k.doc_id = c.id"""

OP11 = r"""WITH x AS (SELECT TRUE AS doc, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT FALSE, -row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT doc, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
f AS (SELECT doc, row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
k AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS t FROM range(256) r(b)),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
c AS (SELECT f, xor(list_reduce(list_transform(range(-1, CAST(len(h) // 2 AS BIGINT)), lambda i: CASE WHEN i < 0 THEN 4294967295 ELSE CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) END), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM u, k),
n AS (SELECT bucket, count(*) FILTER (WHERE doc) AS s, count(*) FILTER (WHERE NOT doc) AS t FROM f JOIN c USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n),
m AS (SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN c USING (f) JOIN g USING (bucket) WHERE doc GROUP BY row),
v AS (SELECT doc_id, row, coalesce(n, 0) AS n_features, len(w) AS words, coalesce(CAST((total - ((total % n) + n) % n) // n AS BIGINT), 0) AS weight, CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m USING (row) WHERE doc),
o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY words >= 20) AS fit FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * fit // 100 THEN place END AS rank FROM r"""

ORACLES = {"op1_near_vectors": OP1, "op5_mix": OP5, "op6_secrets": OP6, "op10_jaccard_join": OP10, "op11_importance_resampling": OP11}
