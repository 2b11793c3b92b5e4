"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import string

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

SQL: dict[str, str] = {}

SQL["op5_line_dedup"] = f"""
WITH doc AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents
), line AS (
  SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM doc
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{UPPER}', '{LOWER}') AS key FROM line
), first AS (
  SELECT key, min(doc_id) AS low FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(f.low < k.doc_id, false) AS lost
  FROM keyed k LEFT JOIN first f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_FINITE = """embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"""

SQL["op1_near_vectors"] = f"""
WITH RECURSIVE ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), low AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
), degree AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, least(v.vec_id, coalesce(low.b, v.vec_id)) AS component_id,
       v.vec_id <= coalesce(low.b, v.vec_id) AS kept
FROM embeddings v LEFT JOIN degree d ON d.a = v.vec_id LEFT JOIN low ON low.a = v.vec_id
"""

SQL["op8_top_k"] = f"""
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE {_FINITE}
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM ok q JOIN ok c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _lloyd(k: int, rounds: int, dim: int) -> str:
    """Rounds of assignment and means, written out one after the other."""
    out = [f"""ok AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND {_FINITE}
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v)::INT - 1 AS c, v FROM ok WHERE vec_id IS NOT NULL
  ORDER BY 1 LIMIT {k}
)"""]
    for i in range(rounds + 1):
        out.append(f"""a{i} AS (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT ok.r, c{i}.c, list_sum(list_transform(list_zip(ok.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM ok CROSS JOIN c{i}) GROUP BY r
)""")
        if i < rounds:
            out.append(f"""m{i} AS (
  SELECT c, list(m ORDER BY j) AS v FROM (
    SELECT a{i}.c, j, floor(sum(ok.v[j])::DOUBLE / count(*))::BIGINT AS m
    FROM a{i} JOIN ok USING (r) CROSS JOIN range(1, {dim + 1}) t(j) GROUP BY a{i}.c, j) GROUP BY c
), c{i + 1} AS (
  SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c)
)""")
    return ", ".join(out)


SQL["op12_centroids"] = f"""
WITH {_lloyd(40, 5, 64)}
SELECT ok.vec_id, a5.c::INT AS cluster, a5.d AS distance, (sum(a5.d) OVER (PARTITION BY a5.c))::BIGINT AS cluster_inertia,
       (sum(a5.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c5.v, ',')) AS centroid_sha256
FROM a5 JOIN ok USING (r) JOIN c5 USING (c)
"""

# CRC-32 of the distinct features from the table of its polynomial, byte by byte.
SQL["op13_resample"] = f"""
WITH RECURSIVE tab(i, k, x) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END FROM tab WHERE k < 8
), crc_table AS (
  SELECT list(x ORDER BY i) AS t FROM tab WHERE k = 8
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), target_words AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), doc_feature AS (
  SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f
  FROM (SELECT row_number() OVER () AS r, w FROM doc_words)
), target_feature AS (
  SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM target_words
), distinct_feature AS (
  SELECT DISTINCT f FROM (SELECT f FROM doc_feature UNION ALL SELECT f FROM target_feature)
), hashed AS (
  SELECT f, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(octet_length(encode(f))),
                   lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c // 256, crc_table.t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM distinct_feature, crc_table
), doc_bucket AS (
  SELECT bucket, count(*) AS s FROM doc_feature JOIN hashed USING (f) GROUP BY bucket
), target_bucket AS (
  SELECT bucket, count(*) AS t FROM target_feature JOIN hashed USING (f) GROUP BY bucket
), total AS (
  SELECT coalesce((SELECT sum(s) FROM doc_bucket), 0)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM target_bucket), 0)::DOUBLE AS t_all
), gain AS (
  SELECT b.i AS bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS g
  FROM range(10000) b(i) LEFT JOIN doc_bucket d ON d.bucket = b.i LEFT JOIN target_bucket x ON x.bucket = b.i CROSS JOIN total
), weighed AS (
  SELECT r, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight
  FROM doc_feature JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM (SELECT row_number() OVER () AS r, * FROM doc_words) LEFT JOIN weighed USING (r)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_words >= 20 AND doc_id IS NOT NULL
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)
"""
