"""SQL (DuckDB) that gives the rows of the queries, built from shared common table expressions."""

from __future__ import annotations

from siltstone.functions.gear import FEATURES, SAMPLE_MASKS, cut_parameters

CHUNK = 1024

def chunked(size: int = CHUNK) -> str:
    """``files`` and ``chunks``."""
    return f"""
files AS (SELECT doc_id AS file_id, coalesce(encode(text), ''::BLOB) AS b FROM documents),
chunks AS (
  SELECT file_id, seq, octet_length(c) AS size, c AS content, sha256(c) AS fp
  FROM (SELECT file_id, s::INT AS seq, array_slice(b, s * {size} + 1, least((s + 1) * {size}, octet_length(b))) AS c
        FROM files, unnest(range((octet_length(b) + {size - 1}) // {size})) AS t(s))
)"""

def unique(size: int = CHUNK) -> str:
    """``numbered`` and ``uniq``: chunks with ids, before and after deduplication."""
    return f"""{chunked(size)},
numbered AS (SELECT *, row_number() OVER (ORDER BY file_id, seq) - 1 AS chunk_id FROM chunks),
uniq AS (
  SELECT row_number() OVER (ORDER BY file_id, seq) - 1 AS chunk_id, fp, file_id, seq, size, content
  FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY file_id, seq) AS n FROM chunks) WHERE n = 1
)"""


CHUNKS, UNIQUE = chunked(), unique()


NUMBER = "('0x' || substr(sha256({}), 1, 16))::UBIGINT::UHUGEINT"


def _doubling(p: str) -> str:
    steps = [f"{p}h1 AS (SELECT chunk_id, i, g AS h FROM {p}geared)"]
    for k in (1, 2, 4, 8, 16, 32):
        steps.append(
            f"{p}h{2 * k} AS (SELECT chunk_id, i, ((h + coalesce(lag(h, {k}) OVER (PARTITION BY chunk_id ORDER BY i), 0::UHUGEINT) * {1 << k}::UHUGEINT)"
            f" % 18446744073709551616::UHUGEINT) AS h FROM {p}h{k})"
        )
    return ",\n".join(steps)


GEAR = f"gear AS (SELECT v::UTINYINT AS v, {NUMBER.format("unhex(printf('%02x', v))")} AS g FROM range(256) AS t(v))"


def _features(source: str, p: str, sample_bits: int) -> str:
    """``{p}feat``: chunk_id and the features of the content of ``source``."""
    mul = ", ".join(f"(({NUMBER.format(repr(f'a{j}'))}) | 1::UHUGEINT) AS a{j}, {NUMBER.format(repr(f'b{j}'))} AS b{j}" for j in range(FEATURES))
    best = ", ".join(f"max((h * a{j} % 18446744073709551616::UHUGEINT + b{j}) % 18446744073709551616::UHUGEINT) AS f{j}" for j in range(FEATURES))
    zero = ", ".join(f"coalesce(f{j}, 0::UHUGEINT) AS f{j}" for j in range(FEATURES))
    return f"""{p}bytes AS (SELECT chunk_id, i, ('0x' || substr(x, (2 * i + 1)::INT, 2))::UTINYINT AS v
          FROM (SELECT chunk_id, hex(content) AS x, octet_length(content) AS size FROM {source}), unnest(range(size)) AS t(i)),
{p}geared AS (SELECT chunk_id, i, g FROM {p}bytes JOIN gear USING (v)),
{_doubling(p)},
{p}linear AS (SELECT {mul}),
{p}best AS (SELECT chunk_id, {best} FROM {p}h64, {p}linear WHERE h & {SAMPLE_MASKS[sample_bits]}::UHUGEINT = 0 GROUP BY chunk_id),
{p}feat AS (SELECT u.chunk_id, {zero} FROM {source} u LEFT JOIN {p}best USING (chunk_id))"""


def features(sample_bits: int = 2, size: int = CHUNK) -> str:
    """``feat``: chunk_id and the features f0, f1, ... as unsigned numbers."""
    return f"{unique(size)},\n{GEAR},\n{_features('uniq', '', sample_bits)}"


def _signed(x: str) -> str:
    return f"(CASE WHEN {x} >= 9223372036854775808::UHUGEINT THEN {x}::HUGEINT - 18446744073709551616::HUGEINT ELSE {x}::HUGEINT END)::VARCHAR"


def keys(sample_bits: int = 2, size: int = CHUNK) -> str:
    """``keyed``: chunk_id, sf0 to sf2, and the hierarchy a, b, c."""
    sf = ", ".join("md5(" + " || ',' || ".join(_signed(f"f{4 * i + j}") for j in range(4)) + f") AS sf{i}" for i in range(3))
    pad = "[" + ", ".join(f"lpad(f{j}::VARCHAR, 20, '0')" for j in range(FEATURES)) + "]"
    return f"""{features(sample_bits, size)},
sorted AS (SELECT chunk_id, {sf}, list_sort({pad}) AS s FROM feat),
keyed AS (SELECT chunk_id, sf0, sf1, sf2, s[12] AS a, md5(array_to_string(s[9:11], ',')) AS b, md5(array_to_string(s[1:8], ',')) AS c FROM sorted)"""


def packed(partition: str, order: str, cap: int = 8, source: str = "keyed") -> str:
    """``packs``: grp, chunk_id, members."""
    by = f"PARTITION BY {partition} " if partition else ""
    part = f"{partition}, " if partition else ""
    return f"""
placed AS (SELECT *, (row_number() OVER ({by}ORDER BY {order}) - 1) // {cap} AS pack FROM {source}),
packs AS (SELECT min(chunk_id) OVER (PARTITION BY {part}pack) AS grp, chunk_id, count(*) OVER (PARTITION BY {part}pack) AS members FROM placed)"""


def cuts(average: int = 256, source: str = "uniq") -> str:
    """``pieces``: chunk_id, seq, s, e of the content-defined pieces of ``source`` (needs RECURSIVE and ``gear``)."""
    least, most, mask = cut_parameters(average)
    byte = "('0x' || substr(x, (2 * pos + 1)::INT, 2))::INT"
    return f"""cut_gear AS (SELECT list((g >> 32)::BIGINT ORDER BY v) AS gl FROM gear),
hexed AS (SELECT chunk_id, size, hex(content) AS x FROM {source}),
walk AS (
  SELECT chunk_id, 0::BIGINT AS s, least({least}, size)::BIGINT AS pos, 0::BIGINT AS fp, NULL::BIGINT AS was, NULL::BIGINT AS e FROM hexed
  UNION ALL
  SELECT chunk_id, CASE WHEN done THEN nxt ELSE s END, CASE WHEN done THEN least(nxt + {least}, size) ELSE nxt END, CASE WHEN done THEN 0 ELSE f END,
         CASE WHEN done THEN s END, CASE WHEN done THEN nxt END
  FROM (SELECT *, (NOT inside) OR (f & {mask}) = 0 AS done, CASE WHEN inside THEN pos + 1 ELSE pos END AS nxt
        FROM (SELECT *, CASE WHEN inside THEN ((fp >> 1) + gl[{byte} + 1]) % 4294967296 ELSE fp END AS f
              FROM (SELECT w.*, h.size, h.x, gl, pos < least(s + {most}, h.size) AS inside FROM walk w JOIN hexed h USING (chunk_id), cut_gear WHERE w.s < h.size)))),
pieces AS (SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY was) - 1 AS seq, was AS s, e FROM walk WHERE e IS NOT NULL)"""


def representative(choice: str) -> str:
    """``reps``: chunk_id, s, e of the piece that stands for a chunk (needs ``pieces``)."""
    ranked = """hashed AS (SELECT p.*, sha256(array_slice(u.content, s + 1, e)) AS fp, p.seq > 0 AND e < u.size AS inner_ FROM pieces p JOIN uniq u USING (chunk_id)),
largest AS (SELECT chunk_id, s, e FROM hashed QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY e - s DESC, s) = 1),"""
    order = "fp, s" if choice.startswith("min_hash") else "e - s DESC, s"
    if not choice.endswith("inner"):
        return f"{ranked}\nreps AS (SELECT chunk_id, s, e FROM hashed QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY {order}) = 1)"
    return f"""{ranked}
best_inner AS (SELECT chunk_id, s, e FROM hashed WHERE inner_ QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY {order}) = 1),
reps AS (SELECT l.chunk_id, coalesce(b.s, l.s) AS s, coalesce(b.e, l.e) AS e FROM largest l LEFT JOIN best_inner b USING (chunk_id))"""


def best_fit(source: str, cap: int = 8) -> str:
    """``fit``: (item, bin) of best-fit merges and then next fit of ``source`` (key, rank, item, size)."""
    pairs = "flatten(list_transform(range(1, len(l)), lambda i: list_transform(range(i + 1, len(l) + 1), lambda j: {'n': -(l[i].n + l[j].n), 'i': i, 'j': j})))"
    both = "{'n': l[p.i].n + l[p.j].n, 'm': list_concat(l[p.i].m, l[p.j].m)}"
    return f"""merges AS (
  SELECT key, list({{'n': size::BIGINT, 'm': [item]}} ORDER BY rank, item) AS l FROM {source} GROUP BY key
  UNION ALL
  SELECT key, list_transform(list_filter(range(1, len(l) + 1), lambda k: k <> p.j), lambda k: CASE WHEN k = p.i THEN {both} ELSE l[k] END)
  FROM (SELECT key, l, list_min(list_filter({pairs}, lambda p: p.n >= -{cap})) AS p FROM merges) WHERE p IS NOT NULL),
merged AS (SELECT key, l FROM merges QUALIFY row_number() OVER (PARTITION BY key ORDER BY len(l)) = 1),
sets_ AS (SELECT key, k::BIGINT AS n, l[k].n AS size, l[k].m AS m FROM merged, unnest(range(1, len(l) + 1)) AS t(k)),
filled AS (
  SELECT key, n, m, n AS bin, size AS fill FROM sets_ WHERE n = 1
  UNION ALL
  SELECT q.key, q.n, q.m, CASE WHEN w.fill + q.size > {cap} THEN q.n ELSE w.bin END, CASE WHEN w.fill + q.size > {cap} THEN q.size ELSE w.fill + q.size END
  FROM filled w JOIN sets_ q ON q.key = w.key AND q.n = w.n + 1),
fit AS (SELECT item, min(item) OVER (PARTITION BY key, bin) AS bin FROM (SELECT key, bin, unnest(m) AS item FROM filled))"""


def next_fit(source: str, name: str = "fit", cap: int = 8) -> str:
    """``name``: (key, n, item, bin, fill) of next fit of ``source`` (key, n, item, size), n counting from 1 in each key."""
    return f"""{name} AS (
  SELECT key, n, item, item AS bin, size AS fill FROM {source} WHERE n = 1
  UNION ALL
  SELECT q.key, q.n, q.item, CASE WHEN w.fill + q.size > {cap} THEN q.item ELSE w.bin END, CASE WHEN w.fill + q.size > {cap} THEN q.size ELSE w.fill + q.size END
  FROM {name} w JOIN {source} q ON q.key = w.key AND q.n = w.n + 1)"""


def rebinned(sample_bits: int = 2, size: int = CHUNK, average: int = 256, by: str = "a", order: str = "b DESC, c DESC, chunk_id", fit: str | None = None) -> str:
    """``first_`` and ``third``: groups (grp, chunk_id, members) of the ranked hierarchy (or ``by`` another key), before and
    after leftovers are put together by their representatives, with next fit (or ``fit``)."""
    return f"""{keys(sample_bits, size)}, {packed(by, order)},
grouped AS (SELECT grp, chunk_id, members FROM packs WHERE members > 1),
first_ AS (SELECT * FROM grouped UNION ALL SELECT chunk_id, chunk_id, 1 FROM uniq WHERE chunk_id NOT IN (SELECT chunk_id FROM grouped)),
{cuts(average)},
{representative('min_hash')},
subs AS (SELECT r.chunk_id, array_slice(u.content, s + 1, e) AS content FROM reps r JOIN uniq u USING (chunk_id)
         WHERE chunk_id IN (SELECT grp FROM first_ WHERE members < 8)),
{_features('subs', 's_', sample_bits)},
items AS (SELECT f.grp AS item, any_value(f.members) AS size, any_value(md5({" || ',' || ".join(_signed(f"k.f{j}") for j in range(4))})) AS key
          FROM first_ f JOIN s_feat k ON k.chunk_id = f.grp WHERE members < 8 GROUP BY f.grp),
seq_ AS (SELECT *, size > 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY size > 1, item) AS n FROM items),
{fit or next_fit('seq_')},
third AS (
  SELECT grp, chunk_id, members FROM first_ WHERE members >= 8
  UNION ALL
  SELECT min(f.chunk_id) OVER (PARTITION BY b.bin), f.chunk_id, count(*) OVER (PARTITION BY b.bin) FROM first_ f JOIN fit b ON b.item = f.grp)"""


NATURAL = r"""array_to_string(list_transform(regexp_extract_all(lower(url), '\d+|\D+'), lambda r:
  CASE WHEN regexp_matches(r, '^\d') THEN '0' || lpad(length(coalesce(nullif(ltrim(r, '0'), ''), '0'))::VARCHAR, 4, '0') || coalesce(nullif(ltrim(r, '0'), ''), '0') ELSE r END), '')"""

_PROBE = "SELECT chunk_id, pos, key FROM (SELECT chunk_id, unnest([0, 1, 2]) AS pos, unnest([sf0, sf1, sf2]) AS key FROM keyed)"
_FLAT = "SELECT DISTINCT chunk_id, unnest([" + ", ".join(f"f{j}" for j in range(FEATURES)) + "]) AS feature FROM feat"

SQL: dict[str, str] = {
    "S2_natural_order": f"SELECT page_id, row_number() OVER (ORDER BY {NATURAL}, url, page_id) - 1 AS place FROM pages",
    "S3_first_files": f"SELECT url FROM pages ORDER BY {NATURAL}, url LIMIT 20",
    "S4_files_from_table": "SELECT doc_id AS file_id, octet_length(encode(text)) AS length, sha256(encode(text)) AS sha256 FROM documents",
    "C1_fixed_chunks": f"WITH {CHUNKS} SELECT file_id, seq, size, fp FROM chunks",
    "D1_unique_chunks": f"WITH {UNIQUE} SELECT chunk_id, fp, file_id, seq, size FROM uniq",
    "D1_recipes": f"WITH {UNIQUE} SELECT c.file_id, c.seq, u.chunk_id FROM chunks c JOIN uniq u USING (fp)",
    "D2_duplicates": f"WITH {UNIQUE} SELECT n.chunk_id, m.first_id FROM numbered n JOIN (SELECT fp, min(chunk_id) AS first_id FROM numbered GROUP BY fp) m USING (fp) WHERE n.chunk_id <> m.first_id",
    "D3_occurrence_histogram": f"WITH {CHUNKS} SELECT occurrences, count(*) AS frequency FROM (SELECT fp, count(*) AS occurrences FROM chunks GROUP BY fp) GROUP BY occurrences",
    "D4_dense_ids": f"WITH {UNIQUE} SELECT file_id, seq, chunk_id FROM numbered",
    "I1_fp_index": f"WITH {UNIQUE} SELECT fp, row_number() OVER (PARTITION BY fp ORDER BY chunk_id) - 1 AS place, chunk_id FROM numbered",
    "F4_features": f"WITH {features()} SELECT chunk_id, " + ", ".join(f"f{j}::VARCHAR AS f{j}" for j in range(FEATURES)) + " FROM feat",
    "F7_F8_keys": f"WITH {keys()} SELECT * FROM keyed",
    "I2_first_key_index": f"WITH {keys()} SELECT sf0 AS key, count(*) AS members FROM keyed GROUP BY sf0",
    "I3_max_feature_index": f"WITH {keys()} SELECT a AS key, count(*) AS members FROM keyed GROUP BY a",
    "I4_hierarchy_sets": f"WITH {keys()} SELECT a, string_agg(bc, ',' ORDER BY bc) AS keys FROM (SELECT DISTINCT a, b || '.' || c AS bc FROM keyed) GROUP BY a",
    "I5_index_after_delete": f"WITH {keys()} SELECT sf0 AS key, count(*) AS members FROM keyed WHERE chunk_id % 2 <> 0 GROUP BY sf0",
    "I6_similar_count": f"WITH {keys()} SELECT coalesce(sum(members), 0)::BIGINT AS similar_chunks FROM (SELECT count(*) AS members FROM keyed GROUP BY sf0) WHERE members > 1",
    "I7_similar_record": f"""WITH {keys()}, probe AS ({_PROBE}),
hits AS (SELECT x.chunk_id, x.pos, min(y.chunk_id) AS other FROM probe x JOIN probe y ON x.pos = y.pos AND x.key = y.key AND x.chunk_id <> y.chunk_id GROUP BY ALL)
SELECT k.chunk_id, arg_min(h.other, h.pos) AS similar_id FROM keyed k LEFT JOIN hits h USING (chunk_id) GROUP BY k.chunk_id""",
    "I11_I12_last_similar_record": f"""WITH {keys()}, probe AS ({_PROBE}),
hits AS (SELECT x.chunk_id, x.pos, max(y.chunk_id) AS other FROM probe x JOIN probe y ON x.pos = y.pos AND x.key = y.key AND x.chunk_id <> y.chunk_id GROUP BY ALL)
SELECT k.chunk_id, arg_min(h.other, h.pos) AS similar_id FROM keyed k LEFT JOIN hits h USING (chunk_id) GROUP BY k.chunk_id""",
    "I9_features_by_bucket_size": f"WITH {features()}, flat AS ({_FLAT}) SELECT feature::VARCHAR AS feature, count(*) AS members FROM flat GROUP BY feature",
    "I10_cooccurrence": f"""WITH {features()}, flat AS (SELECT chunk_id, {_signed('feature')}::BIGINT AS f FROM ({_FLAT}))
SELECT x.f AS f1, y.f AS f2, count(*) AS chunks FROM flat x JOIN flat y ON x.chunk_id = y.chunk_id AND x.f <> y.f GROUP BY ALL""",
    "A7_feature_counts": f"""WITH {keys()} SELECT count(*) AS chunks, count(*) FILTER (a = repeat('0', 20)) AS zero_chunks, count(DISTINCT sf0) AS first_keys, count(DISTINCT a) AS max_features FROM keyed""",
    "G1_by_first_key": f"WITH {keys()}, {packed('sf0', 'chunk_id')} SELECT grp, chunk_id, members FROM packs WHERE members > 1",
    "G2_by_hierarchy": f"WITH {keys()}, {packed('a', 'b, c, chunk_id')} SELECT grp, chunk_id, members FROM packs WHERE members > 1",
    "G3_by_rank": f"WITH {keys()}, {packed('a', 'b DESC, c DESC, chunk_id')} SELECT grp, chunk_id, members FROM packs WHERE members > 1",
    "G9_fp_only": f"WITH {UNIQUE}, {packed('', 'chunk_id', source='uniq')} SELECT grp, chunk_id, members FROM packs",
    "G10_final_merge": f"""WITH {keys()}, {packed('sf0', 'chunk_id')},
grouped AS (SELECT grp, chunk_id, members FROM packs WHERE members > 1)
SELECT * FROM grouped UNION ALL SELECT chunk_id, chunk_id, 1 FROM uniq WHERE chunk_id NOT IN (SELECT chunk_id FROM grouped)""",
    "A5_size_histogram": f"""WITH {keys()}, {packed('sf0', 'chunk_id')}
SELECT 'first' AS stage, members AS group_size, count(DISTINCT grp) AS frequency FROM packs GROUP BY members""",
    "G6_next_fit": """WITH RECURSIVE items AS (
  SELECT l_suppkey AS key, l_orderkey * 1000 + l_linenumber * 10 + l_quantity::INT % 7 AS item, (l_quantity::INT % 7 + 1)::INT AS size FROM lineitem),
seq AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY item) AS n FROM items),
walk AS (
  SELECT key, n, item, item AS bin, size AS fill FROM seq WHERE n = 1
  UNION ALL
  SELECT s.key, s.n, s.item, CASE WHEN w.fill + s.size > 8 THEN s.item ELSE w.bin END, CASE WHEN w.fill + s.size > 8 THEN s.size ELSE w.fill + s.size END
  FROM walk w JOIN seq s ON s.key = w.key AND s.n = w.n + 1)
SELECT item, bin FROM walk""",
    "P5_containers": f"""WITH RECURSIVE {UNIQUE},
walk AS (
  SELECT chunk_id, size, 0 AS container_id, 0 AS "offset" FROM uniq WHERE chunk_id = 0
  UNION ALL
  SELECT u.chunk_id, u.size, CASE WHEN w."offset" + w.size + u.size > 65536 THEN w.container_id + 1 ELSE w.container_id END,
         CASE WHEN w."offset" + w.size + u.size > 65536 THEN 0 ELSE w."offset" + w.size END
  FROM walk w JOIN uniq u ON u.chunk_id = w.chunk_id + 1)
SELECT chunk_id, size, container_id, "offset" FROM walk""",
    "P6_chunk_offsets": f"""WITH {UNIQUE}, {packed('', 'chunk_id', source='uniq')}
SELECT p.grp, p.chunk_id, u.size, coalesce(sum(u.size) OVER (ORDER BY p.grp, p.chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS re_offset
FROM packs p JOIN uniq u USING (chunk_id)""",
    "P7_group_offsets": f"""WITH {UNIQUE}, {packed('', 'chunk_id', source='uniq')},
g AS (SELECT p.grp, sum(u.size)::BIGINT AS orig_size FROM packs p JOIN uniq u USING (chunk_id) GROUP BY p.grp)
SELECT row_number() OVER (ORDER BY grp) - 1 AS group_id, orig_size, coalesce(sum(orig_size) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS comp_offset FROM g""",
    "A1_A4_dedup_summary": f"""WITH {CHUNKS}, each AS (SELECT fp, count(*) AS n, min(size) AS size FROM chunks GROUP BY fp)
SELECT sum(n)::BIGINT AS total_chunks, count(*) AS unique_chunks, sum(n * size)::BIGINT AS logical_size, sum(size)::BIGINT AS unique_size,
       round(sum(n * size)::DOUBLE / sum(size)::DOUBLE, 4) AS dedup_ratio FROM each""",
    "J3_recipe_sizes": f"""WITH {UNIQUE} SELECT c.file_id, sum(u.size)::BIGINT AS length, count(*) AS chunks FROM chunks c JOIN uniq u USING (fp) GROUP BY c.file_id""",
    "J4_never_repeated": f"WITH {CHUNKS} SELECT file_id, seq FROM chunks WHERE fp NOT IN (SELECT fp FROM chunks GROUP BY fp HAVING count(*) > 1)",
    "J5_repeated": f"WITH {CHUNKS} SELECT file_id, seq FROM chunks WHERE fp IN (SELECT fp FROM chunks GROUP BY fp HAVING count(*) > 1)",
    "J8_theta_pairs": f"""WITH {UNIQUE}, few AS (SELECT chunk_id, size FROM uniq WHERE chunk_id < 1024)
SELECT i.chunk_id AS i, count(*) AS pairs, max(j.size) AS largest FROM few i JOIN few j ON i.chunk_id < j.chunk_id AND i.size < j.size GROUP BY i.chunk_id""",
    "A8_collected_sets": "SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(*) AS n FROM lineitem GROUP BY l_suppkey",
    "A10_extremes": f"""WITH {CHUNKS} SELECT file_id, arg_min(seq, fp) AS min_hash_seq, min(fp) AS min_hash, arg_max(seq, size * 100000 - seq) AS largest_seq FROM chunks GROUP BY file_id""",
    "U1_U4_sets": f"""WITH {CHUNKS}, s AS (SELECT DISTINCT md5(coalesce(source, '')) < '8' AS low, fp FROM chunks JOIN documents ON file_id = doc_id),
a AS (SELECT fp FROM s WHERE low), b AS (SELECT fp FROM s WHERE NOT low)
SELECT 'union' AS op, fp FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'append', fp FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
UNION ALL SELECT 'difference', fp FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'intersection', fp FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""",
    "E_functions": """SELECT page_id, string_split(url, '/')[-1] AS basename, lower(hex(encode(url)))[1:16] AS head, ceil(octet_length(encode(html)) / 1000.0)::BIGINT AS blocks,
least(greatest(page_id, 10), 100) AS clamped, round(log2(page_id + 1))::INT AS bits, (page_id << 3) & 255 AS masked FROM pages""",
    "O8_top_pairs": f"""WITH {features()}, flat AS ({_FLAT})
SELECT a.chunk_id AS i, b.chunk_id AS j, count(*) AS shared FROM flat a JOIN flat b ON a.feature = b.feature AND a.chunk_id < b.chunk_id GROUP BY ALL ORDER BY shared DESC, i, j LIMIT 20""",
    "W_places": f"WITH {CHUNKS} SELECT file_id, seq, row_number() OVER (PARTITION BY size ORDER BY file_id, seq) - 1 AS place FROM chunks",
    "I8_probe": f"""WITH {keys()}, probe AS ({_PROBE}), index_ AS (SELECT pos, key, min(chunk_id) AS other FROM probe GROUP BY ALL)
SELECT p.chunk_id AS probe_id, arg_min(i.other, p.pos) AS similar_id FROM probe p JOIN index_ i USING (pos, key) GROUP BY p.chunk_id""",
    "L3_stream_recipes": f"WITH {UNIQUE} SELECT c.file_id, c.seq, u.chunk_id FROM chunks c JOIN uniq u USING (fp)",
    "L3_stream_fingerprints": f"WITH {CHUNKS} SELECT fp, size FROM chunks GROUP BY ALL",
}

SQL |= {
    f"C6_C9_representative_{c}": f"""WITH RECURSIVE {UNIQUE}, {GEAR}, {cuts()}, {representative(c)}
SELECT r.chunk_id, s AS sub_start, e AS sub_end, sha256(array_slice(u.content, s + 1, e)) AS fp FROM reps r JOIN uniq u USING (chunk_id)"""
    for c in ("largest", "min_hash", "largest_inner", "min_hash_inner")
}
SQL |= {
    "G4_hsf_rank_bib": f"WITH RECURSIVE {rebinned()} SELECT * FROM third",
    "G8_hsf_bib": f"""WITH RECURSIVE {rebinned()},
rest AS (SELECT chunk_id, (row_number() OVER (ORDER BY chunk_id) - 1) // 8 AS pack FROM third WHERE members = 1)
SELECT * FROM third WHERE members > 1 UNION ALL SELECT min(chunk_id) OVER (PARTITION BY pack), chunk_id, count(*) OVER (PARTITION BY pack) FROM rest""",
    "flagship": f"""WITH RECURSIVE {rebinned()}
SELECT 'first' AS stage, members AS group_size, count(DISTINCT grp) AS frequency FROM first_ GROUP BY members
UNION ALL SELECT 'final', members, count(DISTINCT grp) FROM third GROUP BY members""",
}

def windows(width: int, base: int, modulus: int, kind: str) -> str:
    """``poly``: chunk_id, i, size, fp of every window of ``width`` bytes of ``uniq``, by doubling: the fingerprint of 2k
    bytes is that of the first k times base**k plus that of the next k."""

    def joined(a: str, b: str, k: int, m: int) -> str:
        return f"(({a} * {pow(base, m, modulus)}::{kind} + lead({b}, {k}) OVER (PARTITION BY chunk_id ORDER BY i)) % {modulus}::{kind})"

    steps = [f"""poly_bytes AS (SELECT chunk_id, i, size, ('0x' || substr(x, (2 * i + 1)::INT, 2))::INT::{kind} AS p1
          FROM (SELECT chunk_id, hex(content) AS x, size FROM uniq), unnest(range(size)) AS t(i))"""]
    k, last = 1, "poly_bytes"
    while 2 * k <= width:
        steps.append(f"poly{2 * k} AS (SELECT *, {joined(f'p{k}', f'p{k}', k, k)} AS p{2 * k} FROM {last})")
        k, last = 2 * k, f"poly{2 * k}"
    rest = width - k
    fp = f"p{k}" if not rest else joined(f"p{k}", f"p{rest}", k, rest)
    steps.append(f"poly AS (SELECT chunk_id, i, size, {fp} AS fp FROM {last})")
    return ",\n".join(steps)


def _strided(sort: bool) -> str:
    """The keys of ``wide`` (chunk_id, f0, ...): every third feature; with ``sort``, each three in order first."""
    three = [f"list_sort([f{3 * j}, f{3 * j + 1}, f{3 * j + 2}])" if sort else f"[f{3 * j}, f{3 * j + 1}, f{3 * j + 2}]" for j in range(4)]
    key = ", ".join("md5(" + " || ',' || ".join(f"{t}[{i + 1}]::VARCHAR" for t in three) + ")" for i in range(3))
    return f"SELECT chunk_id, array_to_string([{key}], ',') AS keys FROM wide"


def ntransform() -> str:
    mul = ", ".join(f"(({NUMBER.format(repr(f'a{j}'))}) | 1::UHUGEINT) AS a{j}, {NUMBER.format(repr(f'b{j}'))} AS b{j}" for j in range(FEATURES))
    value = lambda j: f"((fp * a{j} % 4294967296::UHUGEINT + b{j}) % 4294967296::UHUGEINT)"
    best = ", ".join(f"arg_max(fp, {value(j)}) AS f{j}, max({value(j)}) AS m{j}" for j in range(FEATURES))
    low = ", ".join(f"CASE WHEN coalesce(m{j}, 0::UHUGEINT) > 0 THEN f{j} % 4294967296::UHUGEINT ELSE 0::UHUGEINT END AS f{j}" for j in range(FEATURES))
    return f"""WITH {UNIQUE}, {windows(64, 257, 1 << 64, 'UHUGEINT')},
linear AS (SELECT {mul}),
best AS (SELECT chunk_id, {best} FROM poly, linear WHERE i + 64 < size GROUP BY chunk_id),
wide AS (SELECT u.chunk_id, {low} FROM uniq u LEFT JOIN best USING (chunk_id)) {_strided(False)}"""


def finesse() -> str:
    inside = lambda b: f"i >= size * {b} // 12 AND i + 48 <= size * {b + 1} // 12 AND size // 12 >= 48"
    best = ", ".join(f"coalesce(max(fp) FILTER ({inside(b)}), 0) AS f{b}" for b in range(FEATURES))
    return f"WITH {UNIQUE}, {windows(48, 37, 1_000_000_007, 'BIGINT')},\nwide AS (SELECT chunk_id, {best} FROM poly GROUP BY chunk_id) {_strided(True)}"


SQL["G13_most_correlated"] = f"""WITH {features()}, flat AS (SELECT chunk_id, {_signed('feature')}::BIGINT AS f FROM ({_FLAT}))
SELECT f1, f2, chunks FROM (SELECT x.f AS f1, y.f AS f2, count(*) AS chunks FROM flat x JOIN flat y ON x.chunk_id = y.chunk_id AND x.f <> y.f GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY f1 ORDER BY chunks DESC, f2) = 1"""
SQL |= {"F9_ntransform": ntransform(), "F10_finesse": finesse()}

WHOLE = "whole AS (SELECT file_id AS chunk_id, octet_length(b) AS size, b AS content FROM files)"
SQL |= {
    "C3_cut_points": f"""WITH RECURSIVE {CHUNKS}, {GEAR}, {WHOLE}, {cuts(CHUNK, 'whole')}
SELECT f.file_id, coalesce(string_agg(p.e::VARCHAR, ',' ORDER BY p.e), '') AS ends FROM files f LEFT JOIN pieces p ON p.chunk_id = f.file_id GROUP BY f.file_id""",
    "C5_cdc_chunks": f"""WITH RECURSIVE {CHUNKS}, {GEAR}, {WHOLE}, {cuts(CHUNK, 'whole')}
SELECT p.chunk_id AS file_id, p.seq, e - s AS size, sha256(array_slice(w.content, s + 1, e)) AS fp FROM pieces p JOIN whole w USING (chunk_id)""",
}

RESTORED = "SELECT doc_id AS file_id, octet_length(encode(text)) AS length, sha256(encode(text)) AS sha256 FROM documents"
SQL |= {f"T4_restore_{m}": RESTORED for m in ("lz4", "sf", "hsf", "hsf_rank", "hsf_rank_bib", "sf_bib", "hsf_bib", "sf_nodedup", "fp_sf", "fp_affinity", "fp_only")}

_RANKED = f"""{keys()}, {packed('a', 'b DESC, c DESC, chunk_id')},
grouped AS (SELECT grp, chunk_id, members FROM packs WHERE members > 1),
groups_ AS (SELECT * FROM grouped UNION ALL SELECT chunk_id, chunk_id, 1 FROM uniq WHERE chunk_id NOT IN (SELECT chunk_id FROM grouped))"""

SQL["P2_group_recipes"] = f"""WITH {_RANKED}
SELECT dense_rank() OVER (ORDER BY grp) - 1 AS group_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_id) AS chunk_ids, sum(size)::INT AS orig_size
FROM groups_ JOIN uniq USING (chunk_id) GROUP BY grp"""
SQL["G4_default_parameters"] = f"WITH RECURSIVE {rebinned(5, 8192, 2048)} SELECT * FROM third"
SQL["F7_sorted_super_features"] = (
    f"WITH {keys()} SELECT chunk_id, array_to_string(["
    + ", ".join("md5(" + " || ',' || ".join(_signed(f"s[{4 * i + j + 1}]::UHUGEINT") for j in range(4)) + ")" for i in range(3))
    + "], ',') AS keys FROM sorted"
)


def _last_similar(keyed: str) -> str:
    return f"""WITH kk AS ({keyed}), probe AS (SELECT chunk_id, unnest([0, 1, 2]) AS pos, unnest(string_split(keys, ',')) AS key FROM kk),
hits AS (SELECT x.chunk_id, x.pos, max(y.chunk_id) AS other FROM probe x JOIN probe y ON x.pos = y.pos AND x.key = y.key AND x.chunk_id <> y.chunk_id GROUP BY ALL)
SELECT k.chunk_id, arg_min(h.other, h.pos) AS similar_id FROM kk k LEFT JOIN hits h USING (chunk_id) GROUP BY k.chunk_id"""


SQL |= {"I11_last_similar_by_ntransform": _last_similar(ntransform()), "I12_last_similar_by_finesse": _last_similar(finesse())}


def _quality(method: str, groups: str) -> str:
    return f"""SELECT '{method}' AS method, sum(1.0 / members)::DOUBLE AS g, count(*) AS chunks, count(*) FILTER (members = 1) AS alone FROM ({groups})"""


_PACKED = "SELECT members FROM packs"  # packs of one are groups, too
SQL["A5_grouping_quality"] = f"""SELECT method, round(g)::BIGINT AS groups, chunks, round(100.0::DOUBLE * alone / chunks, 1) AS alone_percent, round(chunks::DOUBLE / round(g), 2) AS mean_chunks FROM (
{_quality('sf', f"WITH {keys()}, {packed('sf0', 'chunk_id')} {_PACKED}")}
UNION ALL {_quality('hsf', f"WITH {keys()}, {packed('a', 'b, c, chunk_id')} {_PACKED}")}
UNION ALL {_quality('hsf_rank', f"WITH {keys()}, {packed('a', 'b DESC, c DESC, chunk_id')} {_PACKED}")}
UNION ALL {_quality('hsf_rank_bib', f"WITH RECURSIVE {rebinned()} SELECT members FROM third")})"""

_PACKED_SINGLES = """rest AS (SELECT chunk_id, (row_number() OVER (ORDER BY chunk_id) - 1) // {cap} AS pack FROM third WHERE members = 1)
SELECT * FROM third WHERE members > 1 UNION ALL SELECT min(chunk_id) OVER (PARTITION BY pack), chunk_id, count(*) OVER (PARTITION BY pack) FROM rest"""

SQL["G5_best_fit"] = f"""WITH RECURSIVE items AS (SELECT o_custkey AS key, 0 AS rank, o_orderkey AS item, (o_orderkey % 7 + 1)::INT AS size FROM orders),
{best_fit('items')} SELECT item, bin FROM fit"""
SQL["G7_sf_bib"] = f"WITH RECURSIVE {rebinned(by='sf0', order='chunk_id', fit=best_fit('seq_'))},\n{_PACKED_SINGLES.format(cap=8)}"


def fp_affinity() -> str:
    largest = "list_max([" + ", ".join(f"lpad(f{j}::VARCHAR, 20, '0')" for j in range(FEATURES)) + "])"
    zero = "'" + "0" * 20 + "'"
    return f"""WITH RECURSIVE {UNIQUE}, {GEAR}, {_features('numbered', '', 2)},
tops AS (SELECT chunk_id, {largest} AS a FROM feat),
counted AS (SELECT chunk_id, fp, (row_number() OVER (PARTITION BY fp ORDER BY chunk_id) - 1) // 16 AS pack FROM numbered),
equal AS (SELECT min(chunk_id) OVER (PARTITION BY fp, pack) AS grp, chunk_id, count(*) OVER (PARTITION BY fp, pack) AS members FROM counted),
items AS (SELECT e.grp AS item, any_value(e.members) AS size, any_value(t.a) AS key FROM equal e JOIN tops t ON t.chunk_id = e.grp WHERE members < 16 GROUP BY e.grp),
seq_ AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY item) AS n FROM items),
marked AS (SELECT * FROM seq_ WHERE key <> {zero}),
unmarked AS (SELECT * FROM seq_ WHERE key = {zero}),
first_fit AS (
  SELECT key, n, item, [16 - size] AS room, [item] AS names, item AS bin FROM marked WHERE n = 1
  UNION ALL
  SELECT key, n, item, CASE WHEN at_ IS NULL THEN list_append(room, 16 - size) ELSE list_transform(room, lambda r, i: CASE WHEN i = at_ THEN r - size ELSE r END) END,
         CASE WHEN at_ IS NULL THEN list_append(names, item) ELSE names END, CASE WHEN at_ IS NULL THEN item ELSE names[at_] END
  FROM (SELECT q.key, q.n, q.item, q.size, w.room, w.names, list_min(list_filter(range(1, len(w.room) + 1), lambda k: w.room[k] >= q.size)) AS at_
        FROM first_fit w JOIN marked q ON q.key = w.key AND q.n = w.n + 1)),
{next_fit('unmarked', 'zero_fit', 16)},
bins AS (SELECT item, bin FROM first_fit UNION ALL SELECT item, bin FROM zero_fit),
second AS (SELECT grp, chunk_id, members FROM equal WHERE members >= 16
           UNION ALL SELECT min(e.chunk_id) OVER (PARTITION BY b.bin), e.chunk_id, count(*) OVER (PARTITION BY b.bin) FROM equal e JOIN bins b ON b.item = e.grp),
heads AS (SELECT n.chunk_id, n.size, n.content FROM numbered n JOIN second s USING (chunk_id) WHERE s.members = 1),
{cuts(256, 'heads')},
subs AS (SELECT h.chunk_id, array_slice(h.content, s + 1, e) AS content
         FROM (SELECT * FROM pieces QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY e - s DESC, s) = 1) JOIN heads h USING (chunk_id)),
{_features('subs', 's_', 2)},
tied AS (SELECT chunk_id, {largest} AS key FROM s_feat),
{packed('key', 'chunk_id', 16, 'tied')},
whole AS (SELECT * FROM second WHERE members > 1 UNION ALL SELECT grp, chunk_id, members FROM packs WHERE members > 1),
third AS (SELECT * FROM whole UNION ALL SELECT chunk_id, chunk_id, 1 FROM numbered WHERE chunk_id NOT IN (SELECT chunk_id FROM whole)),
{_PACKED_SINGLES.format(cap=16)}"""


SQL["G11_fp_affinity"] = fp_affinity()
