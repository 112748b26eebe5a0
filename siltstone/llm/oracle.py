"""SQL (DuckDB) for the queries of this subpackage that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUFFIXES = """
WITH files AS (SELECT doc_id, coalesce(encode(text), ''::BLOB) AS b FROM documents),
win AS (SELECT doc_id, i, md5(array_slice(b, i + 1, i + 100)) AS h FROM files, unnest(range(octet_length(b) - 99)) AS t(i)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 100 THEN 0 ELSE 1 END AS fresh FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z
         FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
pieces AS (SELECT r.doc_id, r.a, array_slice(f.b, coalesce(lag(r.z) OVER (PARTITION BY r.doc_id ORDER BY r.a), 0) + 1, r.a) AS p FROM runs r JOIN files f USING (doc_id)),
kept AS (SELECT doc_id, string_agg(hex(p), '' ORDER BY a) AS x FROM pieces GROUP BY doc_id),
sums AS (SELECT doc_id, count(*) AS n, sum(z - a) AS removed, max(z) AS last FROM runs GROUP BY doc_id)
SELECT f.doc_id, octet_length(f.b) AS n_bytes, coalesce(s.removed, 0)::BIGINT AS n_removed, coalesce(s.n, 0) AS n_spans,
       sha256(unhex(coalesce(k.x, '') || hex(array_slice(f.b, coalesce(s.last, 0) + 1, octet_length(f.b))))) AS kept_sha256
FROM files f LEFT JOIN sums s USING (doc_id) LEFT JOIN kept k USING (doc_id)"""

BENCHMARK = rf"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, m, array_to_string(w[i + 1 : i + m], ' ') AS g
        FROM (SELECT item_id, w, least(13, len(w)) AS m FROM bw WHERE len(w) > 0), unnest(range(len(w) - m + 1)) AS t(i)),
lens AS (SELECT DISTINCT m FROM pat),
grams AS (SELECT doc_id, i, m, array_to_string(w[i + 1 : i + m], ' ') AS g FROM dw, lens, unnest(range(len(w) - m + 1)) AS t(i) WHERE len(w) >= m),
hit AS (SELECT DISTINCT doc_id, i, m, item_id FROM grams JOIN pat USING (m, g)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(m)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

MIXING = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
l AS (SELECT *, source_size * 2.0::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS goal FROM s),
o AS (SELECT *, most / weight AS ratio, coalesce(sum(most) OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
      FROM l WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, (goal - capped) / rest AS level FROM o),
g AS (SELECT source, source_size, coalesce(least(most, (SELECT arg_min(level, ratio) FROM t WHERE level <= ratio) * weight), most) AS target FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM g),
k AS (SELECT source, key, count(*) AS n, sum(size)::BIGINT AS size FROM d GROUP BY source, key),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT d.doc_id, d.size, e.source_size, e.target,
       (e.epochs * d.size + greatest(0, least(d.size, (floor(e.target)::BIGINT - e.epochs * e.source_size - p.before) // p.n)))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.key = p.key"""

_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[{g + 1}] >> {shift}) & 31) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
v AS (SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first, [('0x' || substr(h, 5 * g + 1, 5))::INT FOR g IN range(8)] AS v FROM h)
SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM v"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM w, unnest(range(greatest(1, len(w) - 4))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 10 * c >= 8 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = doc_id), doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.x = doc_id) AS n_links FROM documents"""

SEARCH = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
c AS (SELECT count(*)::DOUBLE AS n, sum(len(w))::DOUBLE / count(*) AS mean FROM d),
t AS (SELECT doc_id, g, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(w) AS g FROM d) GROUP BY doc_id, g),
f AS (SELECT g, ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM t, c GROUP BY g),
x AS (SELECT doc_id, g, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w) / mean)) AS x FROM t JOIN d USING (doc_id), c),
s AS (SELECT q.doc_id AS query_id, x.doc_id, sum(q.tf * idf * x) AS score FROM t q JOIN f USING (g) JOIN x USING (g) WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, x.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10"""

ORACLE_SQL = {"op2_suffix_merge": SUFFIXES, "op5_jaccard_join": NEAR, "op7_wu_manber": BENCHMARK, "op8_mixing": MIXING, "op9_warc": WARC, "op10_bm25_wand": SEARCH}
