"""Oracle SQL of the registered queries that SQL can express, written from their contracts."""

from __future__ import annotations

NEAR_DUPLICATES = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM t),
keyed AS (SELECT r, doc_id, md5(array_to_string(s, '|')) AS k, s FROM s),
class AS (SELECT k, min(doc_id) AS first, count(*) AS copies, any_value(s) AS s, len(any_value(s)) AS n FROM keyed GROUP BY k),
x AS (SELECT k, n, unnest(s) AS g FROM class),
link AS (
  SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.g = b.g AND a.k <> b.k
  GROUP BY a.k, b.k HAVING 5 * count(*) >= 4 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT k AS a, k AS b FROM class UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
head AS (SELECT a AS k, min(c.first) AS class_id FROM reach JOIN class c ON c.k = reach.b GROUP BY a),
links AS (SELECT a AS k, sum(c.copies) AS n FROM link JOIN class c ON c.k = link.b GROUP BY a)
SELECT keyed.doc_id, head.class_id, class.copies AS n_copies, CAST(class.copies - 1 + coalesce(links.n, 0) AS BIGINT) AS n_links
FROM keyed JOIN class USING (k) JOIN head USING (k) LEFT JOIN links USING (k)
"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS i, h FROM d),
grams AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM starts),
least AS (SELECT g, min(doc_id) AS m FROM grams GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, i FROM grams JOIN least USING (g) WHERE m < doc_id),
edge AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + 50 OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS e FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, i, sum(e) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edge),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM spans
  UNION ALL SELECT doc_id, max(z), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, length(h) // 2) - a)), '' ORDER BY a) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sizes AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

URLS = r"""
WITH r AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
  lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS kept FROM h),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
  || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical FROM q),
listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, 'casino|bets|pills')),
fits AS (
  SELECT c.*, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, rule IS NULL AND listed.canonical IS NOT NULL AS listed,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM fits LEFT JOIN listed ON fits.canonical = listed.canonical
"""

# rounds of reshare: sources at their cap leave, the rest share what remains by weight
TARGETS = r"""
WITH RECURSIVE sized AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS DOUBLE) AS words, 1.5 * sum(sum(size)) OVER () AS total, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sized GROUP BY source),
weighed AS (SELECT source, words, total, CASE (k - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, 2 * words AS cap FROM src),
n AS (SELECT count(*) AS n FROM weighed),
rounds AS (
  SELECT 0 AS step, source, words, total, weight, cap, false AS at_cap FROM weighed
  UNION ALL
  SELECT step + 1, source, words, total, weight, cap,
    at_cap OR weight * (total - sum(CASE WHEN at_cap THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN at_cap THEN 0 ELSE weight END) OVER (), 0) > cap
  FROM rounds WHERE step < (SELECT n FROM n)),
last AS (SELECT * FROM rounds WHERE step = (SELECT n FROM n))
SELECT source, CAST(words AS BIGINT) AS source_size,
  round(CASE WHEN at_cap THEN cap ELSE weight * (total - sum(CASE WHEN at_cap THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN at_cap THEN 0 ELSE weight END) OVER () END, 3) AS target
FROM last
"""

EDITED = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id, t), first_value(t) OVER (ORDER BY doc_id, t)) AS after FROM d)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 4) || substr(after, 1, length(t) // 4)) AS edited_sha256 FROM n
"""

COPIES = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""


def _round(k: int) -> str:
    """Clusters of all vectors by the k-th centroids, and the centroids after them."""
    return f"""
far{k} AS (SELECT r, c, list_sum(list_transform(list_zip(q.q, c{k}.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM q, c{k}),
a{k} AS (SELECT r, arg_min(c, d * 16 + c) AS c, min(d) AS d FROM far{k} GROUP BY r),
s{k} AS (SELECT c, i, sum(v) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS v, unnest(range(1, 65)) AS i FROM a{k} JOIN q USING (r)) GROUP BY c, i),
m{k} AS (SELECT c, list(CAST((s - (s % n + n) % n) / n AS BIGINT) ORDER BY i) AS m FROM s{k} GROUP BY c),
c{k + 1} AS (SELECT c{k}.c, coalesce(m{k}.m, c{k}.m) AS m FROM c{k} LEFT JOIN m{k} USING (c))"""


# every vector against every centroid, in each round
CLUSTERS = f"""
WITH kept AS (SELECT vec_id, embedding AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
q AS (SELECT row_number() OVER () AS r, vec_id, list_transform(x, lambda v: CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT)) AS q FROM kept),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, q AS m FROM q ORDER BY sha256('1:' || vec_id) LIMIT 16),
{",".join(map(_round, range(4)))}
SELECT q.vec_id, CAST(a3.c AS INTEGER) AS cluster, CAST(a3.d AS BIGINT) AS distance, CAST(sum(a3.d) OVER (PARTITION BY a3.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a3.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.m, ',')) AS centroid_sha256
FROM a3 JOIN q USING (r) JOIN c3 ON c3.c = a3.c
"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": NEAR_DUPLICATES,
    "op5_suffix_dedup": REPEATS,
    "op9_url_filters": URLS,
    "op11_exact_dedup": COPIES,
    "op13_ball_kmeans": CLUSTERS,
    "mixing_targets": TARGETS,
    "fingerprint_edits": EDITED,
}
