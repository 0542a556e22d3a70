"""DuckDB SQL for the queries that SQL can express."""

ORACLE = {
    "op4_decontamination": """
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM dw),
ig AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM iw),
n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS c FROM dg JOIN ig USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_shingles, c AS n_shared, round(c / n, 9) AS containment
FROM s JOIN n USING (item_id) WHERE c * 5 >= n * 4
""",
    "op9_voronoi_topk": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % 50 = 0) q JOIN e d ON q.vec_id <> d.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op12_columnwise_bwt": """
WITH d AS (SELECT row_number() OVER () AS i, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT i, unnest(range(len(h) // 2)) AS pos FROM d),
s AS (SELECT i, pos, CASE WHEN 2 * pos + 400 <= len(h) THEN md5(substr(h, 2 * pos + 1, 400)) END AS w FROM p JOIN d USING (i)),
r AS (SELECT i, pos, w IS NOT NULL AND count(*) OVER (PARTITION BY w) > 1 AS again FROM s),
c AS (SELECT i, pos, coalesce(pos - max(CASE WHEN again THEN pos END) OVER (PARTITION BY i ORDER BY pos) < 200, false) AS gone FROM r),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY i ORDER BY pos), false) AS opens FROM c),
k AS (SELECT i, count_if(gone) AS n_removed, count_if(opens) AS n_spans,
    string_agg(CASE WHEN NOT gone THEN substr(h, 2 * pos + 1, 2) END, '' ORDER BY pos) AS kept FROM e JOIN d USING (i) GROUP BY i)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (i)
""",
    "op13_balltree_search": """
WITH dt AS (SELECT i, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x{0}-\\x{2F}\\x{3A}-\\x{40}\\x{5B}-\\x{60}\\x{7B}-\\x{7F}]+')) AS t
  FROM (SELECT row_number() OVER () AS i, doc_id, text FROM documents)),
it AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x{0}-\\x{2F}\\x{3A}-\\x{40}\\x{5B}-\\x{60}\\x{7B}-\\x{7F}]+')) AS t FROM benchmark) GROUP BY ALL),
tf AS (SELECT i, doc_id, t, count(*) AS tf FROM dt GROUP BY ALL),
len AS (SELECT i, sum(tf)::BIGINT AS n FROM tf GROUP BY i),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM len),
df AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY t, docs),
s AS (SELECT item_id, i, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM it JOIN tf USING (t) JOIN df USING (t) JOIN len USING (i), whole GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
""",
}


def _clustering(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """One pair of table expressions per round: every vector against every centroid, then exact floors of means."""
    out = f"""
WITH e AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dims}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM e
  ORDER BY sha256('{seed}:' || vec_id), v LIMIT {k}),"""
    for r in range(rounds + 1):
        out += f"""
a{r} AS (SELECT i, vec_id, e.v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT i, vec_id, e.v, c.c,
    CAST(list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM e, c{r} c) e GROUP BY ALL),"""
        if r < rounds:
            out += f"""
m{r} AS (SELECT c, list(x ORDER BY j) AS v FROM (SELECT c, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
    FROM (SELECT c, unnest(v) AS x, unnest(range({dims})) AS j FROM a{r}) GROUP BY c, j) GROUP BY c),
c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c)),"""
    return out + f"""
t AS (SELECT c, CAST(sum(d) AS BIGINT) AS s FROM a{rounds} GROUP BY c)
SELECT vec_id, a.c AS cluster, d AS distance, s AS cluster_inertia, (SELECT CAST(sum(s) AS BIGINT) FROM t) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN t USING (c) JOIN c{rounds} c USING (c)"""


ORACLE["op11_shallot_clustering"] = _clustering()
