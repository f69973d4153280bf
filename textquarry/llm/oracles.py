"""DuckDB SQL for those queries of this package that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT rid, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
           WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
           ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w),
t AS (SELECT rid, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.rid AS x, b.rid AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k
      FROM t a JOIN t b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT x, y FROM c WHERE 100 * k >= 75 * (nx + ny - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT rid, rid FROM s UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT any_value(s.doc_id) AS doc_id, CAST(any_value(len(s.sh)) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM r JOIN s ON s.rid = r.x JOIN s o ON o.rid = r.y GROUP BY r.x
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, rk % 3 + 1 AS weight, 3 * source_size AS cap, 3 * source_size / (rk % 3 + 1) AS full_at FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY full_at, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT l.source, source_size, rk, least(CAST(cap AS DOUBLE), x.level * weight) AS target
      FROM l, (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, rk LIMIT 1) x),
q AS (SELECT d.doc_id, d.size, d.k, t.source_size, t.target, t.rk, row_number() OVER () AS rid,
             sum(d.size) OVER (PARTITION BY t.rk ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS queued
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
v AS (SELECT rid, size, rk, (e * source_size + queued) / target AS v FROM q, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
c AS (SELECT rid, size, sum(size) OVER (ORDER BY v, rk ROWS UNBOUNDED PRECEDING) AS upto FROM v),
k AS (SELECT rid, sum(size) AS taken FROM c WHERE upto <= (SELECT sum(size) FROM d) GROUP BY 1)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (rid)
"""

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, i AS line, regexp_extract_all(lower(xs[i]), '[^ \t\x0B\f\r]+') AS ws
  FROM (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents), unnest(range(1, len(xs) + 1)) AS u(i)),
o AS (SELECT doc_id, line, array_to_string(ws, ' ') AS s, ws FROM l WHERE len(ws) >= 5),
d AS (SELECT s, min((doc_id, line)) AS first, any_value(ws) AS ws FROM o GROUP BY s),
v AS (SELECT s, first, i, CASE WHEN i = 0 THEN s ELSE array_to_string(ws[1:i - 1] || ws[i + 1:len(ws)], ' ') END AS k
      FROM d, unnest(range(0, len(ws) + 1)) AS u(i)),
n AS (SELECT DISTINCT a.s FROM v a JOIN v b ON a.k = b.k AND b.first < a.first AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
g AS (SELECT o.doc_id, list(o.line) AS gone FROM o JOIN d USING (s)
      WHERE (o.doc_id, o.line) <> d.first OR o.s IN (SELECT s FROM n) GROUP BY 1),
t AS (SELECT doc_id, text, coalesce(gone, []) AS gone, string_split(text, chr(10)) AS xs FROM documents LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(coalesce(len(xs), 0) AS INTEGER) AS n_lines, CAST(len(gone) AS INTEGER) AS n_dropped,
       CASE WHEN len(gone) = 0 THEN text ELSE array_to_string([xs[i] for i in range(1, len(xs) + 1) if NOT list_contains(gone, i)], chr(10)) END AS text
FROM t
"""



def _vector_codes(rounds: int = 6) -> str:
    """Every round is a few common table expressions: the assignment of all parts and the next codebooks."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT rid, p, any_value(x) AS x, arg_min(e, d * 16 + e) AS e, min(d) AS d
  FROM (SELECT rid, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v JOIN b{r} USING (p)) GROUP BY 1, 2),
"""
    mean = """b{n} AS MATERIALIZED (
  SELECT b{r}.p, b{r}.e, coalesce(m.c, b{r}.c) AS c FROM b{r} LEFT JOIN (
    SELECT p, e, list(s ORDER BY i) AS c FROM (
      SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS s FROM a{r}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY 1, 2, 3) GROUP BY 1, 2) m
  ON m.p = b{r}.p AND m.e = b{r}.e),
"""
    steps = "".join(nearest.format(r=r) + mean.format(r=r, n=r + 1) for r in range(rounds)) + nearest.format(r=rounds)
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rid, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM k, unnest(range(8)) AS u(p)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS c FROM v WHERE rid <= 16),
{steps}w AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM w JOIN k USING (rid), h
"""


FILTER_AUDIT = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT t, min(doc_id) AS least FROM w GROUP BY 1),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w JOIN m USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM a p, a q, a r, a s, a t
      WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
g AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
h AS (
  SELECT part, filter_order, step, own, n, good, toxic, strpos(fails, own) > 0 AS here,
         len(before) > 0 AND len(translate(fails, before, '')) < len(fails) AS gone, fails = own AS alone
  FROM g, c),
r AS (
  SELECT part, filter_order, step, any_value(own) AS own, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (here AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS toxic_lost
  FROM h GROUP BY 1, 2, 3)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""

SQL: dict[str, str] = {"op1_ngram_jaccard": NGRAM_JACCARD, "op4_mixing": MIXING, "op9_line_dedup": LINE_DEDUP, "op11_vector_codes": _vector_codes(), "op12_filter_audit": FILTER_AUDIT}
