"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from veilgrain.llm import mixing, sharding

WORD = r"[^\x20\x09-\x0D]+"

#: Seats are found by ranking all quotients, which the operator avoids.
MIXING = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, ('0x' || substr(md5('{mixing.SEED}|' || doc_id), 1, 15))::BIGINT AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, list_extract([5.0, 2.0, 1.0], (rn - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * ss AS cap FROM s),
l AS (SELECT *, ((sum(ss) OVER ())::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY cap / weight, rn)),
t AS (SELECT *, least(coalesce(max(level) FILTER (WHERE level <= cap / weight) OVER (), 0) * weight, cap) AS target, greatest(ceil(ss / {mixing.CELL_WORDS}.0), 1)::BIGINT AS cells, floor((sum(ss) OVER ()) / {mixing.BLOCK}.0 + 0.5)::BIGINT AS seats FROM l),
q AS (SELECT rn, target / (2 * k - 1) AS quotient, seats FROM (SELECT *, unnest(range(1, (3 * ss // {mixing.BLOCK} + 3)::BIGINT)) AS k FROM t)),
won AS (SELECT rn, count(*) AS source_seats FROM (SELECT rn FROM q QUALIFY row_number() OVER (ORDER BY quotient DESC, rn) <= seats) GROUP BY rn),
p AS (SELECT d.*, t.rn, t.ss, t.target, d.ord % t.cells AS cell FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT rn, cell, sum(size)::BIGINT AS cw, CASE WHEN sum(size) > 0 THEN greatest(1, floor(sum(size) / {mixing.BLOCK}.0 + 0.5)) ELSE 0 END::BIGINT AS blocks FROM p GROUP BY rn, cell),
m AS (SELECT c.*, least(coalesce(source_seats, 0), 3 * sum(blocks) OVER (PARTITION BY c.rn)) AS seats FROM c LEFT JOIN won ON won.rn = c.rn),
r AS (SELECT rn, cell, blocks / (2 * k - 1)::DOUBLE AS quotient, seats FROM (SELECT *, unnest(range(1, 3 * blocks + 3)) AS k FROM m)),
u AS (SELECT rn, cell, count(*) AS quota FROM (SELECT rn, cell FROM r QUALIFY row_number() OVER (PARTITION BY rn ORDER BY quotient DESC, cell) <= seats) GROUP BY rn, cell),
f AS (SELECT p.doc_id, p.size, p.ss, p.target, m.cw, m.blocks, least(coalesce(u.quota, 0), 3 * m.blocks)::BIGINT AS quota,
  coalesce(sum(p.size) OVER (PARTITION BY p.rn, p.cell ORDER BY p.ord, p.doc_id, p.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
  ('0x' || substr(md5('{mixing.SEED}|' || coalesce(p.source, '') || '|' || p.cell), 1, 15))::BIGINT AS shift
  FROM p JOIN m ON m.rn = p.rn AND m.cell = p.cell LEFT JOIN u ON u.rn = p.rn AND u.cell = p.cell)
SELECT doc_id, size, ss AS source_size, target, (CASE WHEN size = 0 THEN 0 ELSE list_sum(list_transform(range(floor(pos * blocks / cw::DOUBLE)::BIGINT, floor((pos + size - 1) * blocks / cw::DOUBLE)::BIGINT + 1),
  lambda j: (quota // blocks + CASE WHEN (j * {mixing.STRIDE} + shift % blocks) % blocks < quota % blocks THEN 1 ELSE 0 END) * (least(ceil((j + 1) * cw / blocks::DOUBLE)::BIGINT, pos + size) - greatest(ceil(j * cw / blocks::DOUBLE)::BIGINT, pos)))) END)::BIGINT AS taken
FROM f
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
s AS (SELECT doc_id, i, array_to_string(list(w) OVER o, ' ') AS s, count(*) OVER o AS n FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM s WHERE n = 20),
g AS (SELECT w.doc_id, w.i, w.w, coalesce(bool_or(r.again) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.i = w.i),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

#: (codes): the table of CRC-32, which the expression of `crc32` folds over a text's bytes.
CRC_CODES = "SELECT list(v ORDER BY b) AS codes FROM (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) t(b))"


def crc32(hexed: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT)), lambda a, x: xor(a >> 8, codes[(xor(a, x) & 255) + 1])), 4294967295)"


#: The splitters don't show: only the order (key, doc_id) decides.  
SHARDING = f"""
WITH c AS ({CRC_CODES}),
d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS key FROM documents),
z AS (SELECT doc_id, key, (length(h) // 2 + 1)::BIGINT AS size, {crc32("h")} AS crc FROM d, c),
o AS (SELECT *, sum(size) OVER (ORDER BY key, doc_id, size) - size AS pos, sum(size) OVER (PARTITION BY key) AS own, sum(size) OVER () AS total FROM z),
s AS (SELECT *, least({sharding.SHARDS - 1}, floor((CASE WHEN own <= {sharding.WHOLE_SHARE} * total / {sharding.SHARDS} THEN min(pos) OVER (PARTITION BY key) ELSE pos END) * {sharding.SHARDS} / total::DOUBLE))::INT AS shard FROM o)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY pos, doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""

_K, _ROUNDS, _DIMS = 40, 5, 64


def _clustering() -> str:
    """Every round assigns all vectors by comparing them with all centroids, and takes floors of means."""
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {_DIMS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {_DIMS})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS n, x FROM v QUALIFY n < {_K})",
    ]
    for k in range(_ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, r, x, p.d AS distance, p.n AS cluster FROM (SELECT v.vec_id, v.r, v.x, min({{'d': {apart}, 'n': c.n}}) AS p FROM v, c{k} c GROUP BY ALL))")
        if k < _ROUNDS:
            mean = f"SELECT cluster AS n, i, (s - ((s % m) + m) % m) // m AS x FROM (SELECT cluster, i, sum(x[i])::BIGINT AS s, count(*) AS m FROM a{k}, range(1, {_DIMS + 1}) t(i) GROUP BY cluster, i)"
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT n, list(x ORDER BY i) AS x FROM ({mean}) GROUP BY n) m ON m.n = c.n)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{_ROUNDS} a JOIN c{_ROUNDS} c ON c.n = a.cluster"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}, '-')"


#: All levels of all trees by a recursive query, then every row's way up by another.
MANIFEST = f"""
WITH RECURSIVE c AS ({CRC_CODES}),
d AS (SELECT *, {crc32("hex(encode(doc_id::VARCHAR))")} % 7 = 0 AND n_chars IS NOT NULL AS odd FROM documents, c),
f AS MATERIALIZED (SELECT coalesce('1' || lang, '0') AS g, doc_id, sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
  sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "(CASE WHEN odd THEN n_chars::HUGEINT + 1 ELSE n_chars END)", "text")))}) AS bad FROM d),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM f),
t AS (SELECT g, 0 AS lvl, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM n UNION ALL SELECT g, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY g, lvl, i // 2, n),
r AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, h, count(*) OVER () AS n FROM r UNION ALL SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, i // 2, n),
s AS (SELECT a.g, a.lvl, a.i, a.n, coalesce(b.h, '') AS sib FROM t a LEFT JOIN t b ON b.g = a.g AND b.lvl = a.lvl AND b.i = xor(a.i, 1) WHERE a.n > 1),
o AS (SELECT a.lvl, a.i, coalesce(b.h, '') AS sib FROM u a LEFT JOIN u b ON b.lvl = a.lvl AND b.i = xor(a.i, 1) WHERE a.n > 1),
w AS (SELECT n.g, n.doc_id, n.leaf, n.i AS place, 0 AS lvl, n.i, '' AS proof, n.bad AS f FROM n
  UNION ALL SELECT w.g, w.doc_id, w.leaf, w.place, w.lvl + 1, w.i // 2, w.proof || s.sib, sha256(CASE WHEN w.i % 2 = 1 THEN s.sib || w.f ELSE w.f || s.sib END) FROM w JOIN s ON s.g = w.g AND s.lvl = w.lvl AND s.i = w.i),
x AS (SELECT w.g, w.doc_id, w.leaf, w.place, 0 AS lvl, r.i, w.proof, w.f FROM w JOIN r ON r.g = w.g QUALIFY row_number() OVER (PARTITION BY w.g, w.place ORDER BY w.lvl DESC) = 1
  UNION ALL SELECT x.g, x.doc_id, x.leaf, x.place, x.lvl + 1, x.i // 2, x.proof || o.sib, sha256(CASE WHEN x.i % 2 = 1 THEN o.sib || x.f ELSE x.f || o.sib END) FROM x JOIN o ON o.lvl = x.lvl AND o.i = x.i)
SELECT x.doc_id, x.leaf, r.h AS subroot, u.h AS root, sha256(x.proof) AS proof_sha256, x.f AS folded_root, x.f = u.h AS verified
FROM x JOIN r ON r.g = x.g JOIN u ON u.n = 1 QUALIFY row_number() OVER (PARTITION BY x.g, x.place ORDER BY x.lvl DESC) = 1
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PAGES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, t, sha1(t) AS s, row_number() OVER (PARTITION BY t ORDER BY page_id) AS nth, first_value(page_id) OVER (PARTITION BY t ORDER BY page_id) AS least FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', (((('0x' || substr(s, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN least END AS refers_to FROM h
"""

SQL = {"op5_substring_dedup": SUBSTRINGS, "op9_mixing": MIXING, "op10_sharding": SHARDING, "op11_centroid_clustering": _clustering(), "op12_merkle_manifest": MANIFEST, "op13_warc": PAGES}
