"""DuckDB SQL for the queries of these operators that SQL can express.

The rest are tested against brute force: fitted models (1, 12), approximate search (2, 10), tokenizers (3, 8).
"""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE bytes >= 100 GROUP BY digest)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""

OP5 = rf"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM s),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.*, keeper IS NOT NULL AND doc_id < keeper AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

OP6 = rf"""
WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS seq
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)),
f AS (SELECT seq, min(doc_id) AS first FROM win GROUP BY seq HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i, 1 AS hit FROM win JOIN f USING (seq) WHERE first < doc_id),
c AS (SELECT x.*, coalesce(max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM x LEFT JOIN g USING (doc_id, i)),
n AS (SELECT doc_id, count(*) AS n, sum(gone) AS m, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(m, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN n USING (doc_id)
"""

OP7 = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM h a JOIN h b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""

OP9 = rf"""
WITH s AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size,
  CAST('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS total FROM s GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM t),
r AS (SELECT *, sum(total) OVER () AS al,
  coalesce(sum(total) OVER (ORDER BY 2 * total / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY 2 * total / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind FROM w),
f AS (SELECT *, 2 * total / weight <= (1.5::DOUBLE * al - 2 * before) / behind AS ful FROM r),
v AS (SELECT *, (1.5::DOUBLE * al - 2 * coalesce(sum(total) FILTER (WHERE ful) OVER (), 0)) / sum(weight) FILTER (WHERE NOT ful) OVER () AS level FROM f),
g AS (SELECT source, total, CASE WHEN ful THEN 2 * total::DOUBLE ELSE level * weight END AS target FROM v),
d AS (SELECT s.*, total, target, floor(target / nullif(total, 0)) AS sure, target / nullif(total, 0) - floor(target / nullif(total, 0)) AS part
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
o AS (SELECT *, target - sure * total AS need,
  sum(size) OVER (PARTITION BY source ORDER BY u, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM d),
c AS (SELECT *, part > 0 AND run <= need AS chosen FROM o),
y AS (SELECT *, need - coalesce(max(run) FILTER (WHERE chosen) OVER (PARTITION BY source), 0) AS gap FROM c),
z AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN NOT chosen AND part > 0 AND abs(size - gap) < gap THEN 0 ELSE 1 END, abs(size - gap), u, doc_id NULLS FIRST, size) AS place FROM y)
SELECT doc_id, size, total AS source_size, target,
  (size * (coalesce(sure, 0) + CASE WHEN chosen OR (place = 1 AND NOT chosen AND part > 0 AND abs(size - gap) < gap) THEN 1 ELSE 0 END))::BIGINT AS taken FROM z
"""

def _rounds(n: int) -> str:
    """Assignments a0, a1, ... of vectors v to centroids c0, c1, ..., as common table expressions."""
    near = """a{i} AS (SELECT id, v, min({{'d': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'k': k}}) AS near
  FROM v CROSS JOIN c{i} GROUP BY id, v)"""
    move = """m{i} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT near['k'] AS k, unnest(v) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY k, j),
c{j} AS (SELECT k, coalesce(list((s - ((s % n) + n) % n) // n ORDER BY j) FILTER (WHERE n IS NOT NULL), any_value(c))::BIGINT[] AS c FROM c{i} LEFT JOIN m{i} USING (k) GROUP BY k)"""
    parts = [part.format(i=i, j=i + 1) for i in range(n) for part in (near, move)]
    return ",\n".join([*parts, near.format(i=n)])


OP11 = f"""
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || id::VARCHAR)) - 1 AS k, v AS c FROM v QUALIFY k < 16),
{_rounds(3)}
SELECT id AS vec_id, k::INT AS cluster, near['d'] AS distance, sum(near['d']) OVER (PARTITION BY k)::BIGINT AS cluster_inertia,
  sum(near['d']) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON k = near['k']
"""

OP13 = rf"""
WITH tab AS (SELECT list(list_reduce(range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT doc_id, unnest(w) AS word FROM d),
y AS (SELECT unnest(w) AS word FROM e),
b AS (SELECT word, xor(list_reduce(range(strlen(word)),
    lambda c, i: xor(c >> 8, t[xor(c & 255, ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) + 1]), 4294967295), 4294967295) % 10000 AS b
  FROM (SELECT word FROM x UNION SELECT word FROM y), tab),
s AS (SELECT b, count(*) AS s FROM x JOIN b USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM y JOIN b USING (word) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM x) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM y) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (b)),
m AS (SELECT doc_id, sum(gain)::BIGINT AS total, count(*) AS n FROM x JOIN b USING (word) JOIN g USING (b) GROUP BY doc_id),
f AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (doc_id)),
o AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM o)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM r
"""

ORACLE = {"op4_warc": OP4, "op5_line_dedup": OP5, "op6_substring_dedup": OP6, "op7_ngram_join": OP7, "op9_mixing": OP9, "op11_centroids": OP11, "op13_resampling": OP13}
