"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from . import license_scan

ORACLES: dict[str, str] = {}

ORACLES["op1_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS i, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, i, u.k, array_to_string(w[k : k + 12], ' ') AS win FROM d, range(1, len(w) - 11) AS u(k)),
m AS (SELECT win, min(i) AS first FROM p GROUP BY win),
g AS (SELECT p.r, p.k FROM p JOIN m USING (win) WHERE m.first < p.i),
x AS (SELECT d.r, u.k FROM d, range(1, len(w) + 1) AS u(k)),
c AS (SELECT r, k + o AS k FROM g, range(0, 13) AS v(o)),
gone AS (SELECT DISTINCT r, k FROM c),
s AS (SELECT d.r, any_value(d.doc_id) AS doc_id, any_value(len(d.w)) AS n, count(gone.k) AS removed, string_agg(d.w[x.k], ' ' ORDER BY x.k) FILTER (gone.k IS NULL) AS kept FROM d LEFT JOIN x ON x.r = d.r LEFT JOIN gone ON gone.r = x.r AND gone.k = x.k GROUP BY d.r)
SELECT doc_id, n::BIGINT AS n_words, removed::BIGINT AS n_removed, sha256(CASE WHEN n = removed THEN '' ELSE kept END) AS kept_sha256 FROM s
"""
ORACLES["op3_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS d FROM p),
m AS (SELECT d, max(page_id) AS first FROM q WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, q.d AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q LEFT JOIN m ON q.d = m.d
"""

ORACLES["op4_decontaminate"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win FROM b, range(1, greatest(len(w) - 8, 2)) AS u(k) WHERE len(w) > 0),
z AS (SELECT DISTINCT n FROM t),
p AS (SELECT r, n, u.k, array_to_string(w[k : k + n - 1], ' ') AS win FROM d, z, range(1, len(w) - n + 2) AS u(k)),
h AS (SELECT p.r, p.k, p.n, t.item FROM p JOIN t ON p.n = t.n AND p.win = t.win),
hit AS (SELECT r, count(DISTINCT k + o) AS n_hit FROM h, range(0, 10) AS v(o) WHERE o < h.n GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN it ON d.r = it.r
"""

ORACLES["op5_chat"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(0, 2) AS u(i)),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, replace(replace(text, '\', '\s'), '<', '\l') AS t, replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g') AS r FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
 (sum(length(t) + length(r) + 7) + 8 * count(*) FILTER (before IS NULL OR before <> role))::BIGINT AS formatted_chars FROM o GROUP BY conv_id
"""


def _license_sql() -> str:
    rows = []
    for k, text in license_scan.TEMPLATES.items():
        w = license_scan.words_of(text)
        runs = dict.fromkeys(" ".join(w[i : i + license_scan.SHINGLE]) for i in range(max(1, len(w) - license_scan.SHINGLE + 1)))
        rows.append(f"('{k}', {len(w)}, {license_scan.stride(len(w))}, [{', '.join(repr(r) for r in runs)}])")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
l(id, t, s, need) AS (VALUES {', '.join(rows)}),
g AS (SELECT id, t, s, len(need) AS n, unnest(need) AS run FROM l),
p AS (SELECT r, u.k - 1 AS k, array_to_string(w[u.k : u.k + 4], ' ') AS run FROM d, range(1, greatest(len(w) - 3, 2)) AS u(k) WHERE len(w) > 0),
x AS (SELECT p.r, p.k, g.* FROM p JOIN g ON p.run = g.run),
y AS (SELECT r, id, n, run, v.j FROM x, range(greatest(0, (k + 5 - (t + s - 1) + s - 1) // s), k // s + 1) AS v(j)),
f AS (SELECT DISTINCT r, id FROM (SELECT r, id, j, n, count(DISTINCT run) AS c FROM y GROUP BY ALL) WHERE c >= 0.8::DOUBLE * n - 1e-9)
SELECT any_value(doc_id) AS doc_id, count(id)::BIGINT AS n_licenses, coalesce(string_agg(id, ',' ORDER BY id), '') AS license_ids FROM d LEFT JOIN f ON d.r = f.r GROUP BY d.r
"""


ORACLES["op2_license_scan"] = _license_sql()

# reach(a, b): b can be reached from a by links
_REACH = """both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)"""

# d: rows, t: distinct texts, s: their shingles with numbers, c: shared shingles of two texts with numbers x, y and totals tx, ty.
# A shared shingle adds 1 / sum over all j of greatest(xj / x, yj / y): those with xj / yj >= x / y count by x, the others by y.
# The sum of least(x / tx, y / ty) is no smaller than the similarity, and chooses the pairs that are worth it.
ORACLES["op8_near_dup"] = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS MATERIALIZED (SELECT arg_min(r, (doc_id IS NULL, doc_id, r)) AS t, w FROM d WHERE len(w) > 0 GROUP BY w),
s AS MATERIALIZED (SELECT t, win, count(*)::DOUBLE AS n FROM (SELECT t, array_to_string(w[k : k + 4], ' ') AS win FROM t, range(1, greatest(len(w) - 3, 2)) AS u(k)) GROUP BY ALL),
z AS MATERIALIZED (SELECT t, sum(n) AS total, max(n) AS most FROM s GROUP BY t),
c AS MATERIALIZED (SELECT p.t AS a, q.t AS b, p.n AS x, q.n AS y, zp.total AS tx, zq.total AS ty, greatest(zp.most, zq.most) AS most
  FROM s p JOIN s q ON p.win = q.win AND p.t < q.t JOIN z zp ON zp.t = p.t JOIN z zq ON zq.t = q.t),
near AS (SELECT a, b FROM c GROUP BY a, b HAVING sum(least(x / tx, y / ty)) >= 0.8 - 1e-9),
v AS (SELECT *, coalesce(sum(x) OVER below, 0) AS bx, coalesce(sum(y) OVER below, 0) AS ly, sum(y) OVER (PARTITION BY a, b) AS cy FROM c SEMI JOIN near USING (a, b)
  WINDOW below AS (PARTITION BY a, b ORDER BY x / y RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)),
j AS (SELECT a, b, CASE WHEN any_value(most) = 1 THEN count(*) / (any_value(tx) + any_value(ty) - count(*)) ELSE sum(1 / ((tx - bx) / x + (ty - cy + ly) / y)) END AS similarity FROM v GROUP BY a, b),
link AS MATERIALIZED (SELECT a, b FROM j WHERE similarity >= 0.8::DOUBLE),
{_REACH},
g AS (SELECT t, w, list_min(list(f)) AS f FROM (SELECT t.t, t.w, (d.doc_id IS NULL, d.doc_id, d.r) AS f FROM t JOIN d ON d.r = t.t UNION ALL SELECT t.t, t.w, (d.doc_id IS NULL, d.doc_id, d.r) FROM t JOIN reach ON reach.a = t.t JOIN d ON d.r = reach.b) GROUP BY t, w),
o AS (SELECT d.r, d.doc_id, g.f FROM d LEFT JOIN g ON d.w = g.w)
SELECT o.doc_id, CASE WHEN o.f IS NULL THEN o.doc_id ELSE e.doc_id END AS class_id, coalesce(e.r = o.r, true) AS kept FROM o LEFT JOIN d e ON e.r = o.f[3]
"""

ORACLES["op9_embedding_dup"] = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS MATERIALIZED (SELECT r, list_transform(v, lambda x: x / n) AS u FROM (SELECT r, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0) WHERE n > 0),
link AS MATERIALIZED (SELECT p.r AS a, q.r AS b FROM ok p, ok q WHERE p.r < q.r AND CASE WHEN len(p.u) = len(q.u) THEN list_dot_product(p.u, q.u) >= 0.95::DOUBLE ELSE false END),
{_REACH},
n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a),
g AS (SELECT reach.a, min(e.vec_id) AS least FROM reach JOIN e ON e.r = reach.b GROUP BY reach.a)
SELECT vec_id, n_links, component_id, coalesce(component_id = vec_id, component_id IS NULL) AS kept
FROM (SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(least(e.vec_id, g.least), e.vec_id, g.least) AS component_id FROM e LEFT JOIN n ON n.a = e.r LEFT JOIN g ON g.a = e.r)
"""
