"""SQL that says the same as the queries of the codes and of the filter audit."""

CODES = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rn, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), comps AS MATERIALIZED (
  SELECT rn, (k - 1) // (n // 16) AS p, (k - 1) % (n // 16) AS k, CAST(floor(256 * CAST(embedding[k] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT rn, embedding, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS k FROM kept)
), b0 AS MATERIALIZED (SELECT p, rn AS e, k, x AS y FROM comps WHERE rn < 64)
""" + "".join(f"""
, a{r} AS MATERIALIZED (
  SELECT rn, p, e, d FROM (
    SELECT c.rn, c.p, b.e, CAST(sum((c.x - b.y) * (c.x - b.y)) AS BIGINT) AS d
    FROM comps c JOIN b{r} b ON c.p = b.p AND c.k = b.k GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY rn, p ORDER BY d, e) = 1
)""" + (f"""
, b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.k, CASE WHEN m.n IS NULL THEN b.y ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS y
  FROM b{r} b LEFT JOIN (
    SELECT c.p, a.e, c.k, sum(c.x) AS s, count(*) AS n FROM comps c JOIN a{r} a ON c.rn = a.rn AND c.p = a.p GROUP BY ALL
  ) m ON m.p = b.p AND m.e = b.e AND m.k = b.k
)""" if r < 2 else "") for r in range(3)) + """
, coded AS (
  SELECT kept.vec_id, kept.label, string_agg(printf('%02x', a2.e), '' ORDER BY a2.p) AS code, CAST(sum(a2.d) AS BIGINT) AS error
  FROM a2 JOIN kept ON a2.rn = kept.rn GROUP BY kept.rn, kept.vec_id, kept.label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, k)) FROM b2) AS codebooks_sha256
FROM coded
"""

FILTERS = r"""
WITH marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels GROUP BY doc_id
), texts AS MATERIALIZED (
  SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS t,
    regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS w,
    coalesce(m.good, FALSE) AS good, coalesce(m.toxic, FALSE) AS toxic
  FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id
), facts AS MATERIALIZED (
  SELECT part, good, toxic, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)] AS fails
  FROM texts
), sets AS MATERIALIZED (SELECT part, good, toxic, fails, count(*) AS n FROM facts GROUP BY ALL
), letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS f
), orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (SELECT o, i AS step, o[i] AS f, o[1:i - 1] AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS i)
), counted AS MATERIALIZED (
  SELECT part, o, step, f,
    sum(n) FILTER (NOT list_bool_or(list_transform(o[1:step], lambda x: fails[x]))) AS kept,
    sum(n) FILTER (fails[f] AND NOT coalesce(list_bool_or(list_transform(earlier, lambda x: fails[x])), FALSE)) AS removed,
    sum(n) FILTER (fails[f] AND coalesce(list_bool_or(list_transform(earlier, lambda x: fails[x])), FALSE)) AS redundant,
    sum(n) FILTER (fails[f] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    sum(n) FILTER (good AND fails[f] AND NOT coalesce(list_bool_or(list_transform(earlier, lambda x: fails[x])), FALSE)) AS good_lost,
    sum(n) FILTER (toxic AND fails[f] AND NOT coalesce(list_bool_or(list_transform(earlier, lambda x: fails[x])), FALSE)) AS toxic_lost
  FROM sets, steps GROUP BY part, o, step, f
)
SELECT part, list_aggregate(list_transform(o, lambda x: chr(CAST(64 + x AS INTEGER))), 'string_agg', '') AS filter_order, step,
  CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM counted
"""
