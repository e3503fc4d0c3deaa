"""DuckDB SQL for the results of those corpus queries that SQL can express, by brute force."""

WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')"

JACCARD = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {WORDS} AS ws FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS s FROM w),
c AS MATERIALIZED (SELECT s, min(doc_id) AS rep, count(*) AS size FROM g WHERE len(s) > 0 GROUP BY s),
e AS MATERIALIZED (SELECT rep, size, len(s) AS n, unnest(s) AS x FROM c),
p AS MATERIALIZED (
  SELECT a.rep AS u, b.rep AS v, b.size AS vsize FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n, b.size HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
reach(node, root) AS (SELECT rep, rep FROM c UNION SELECT p.v, reach.root FROM reach JOIN p ON p.u = reach.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
links AS (SELECT u, sum(vsize) AS k FROM p GROUP BY u)
SELECT g.doc_id, coalesce(comp.component_id, g.doc_id)::BIGINT AS component_id, (coalesce(c.size, 1) - 1 + coalesce(links.k, 0))::BIGINT AS n_links,
  coalesce(c.size, 1)::BIGINT AS class_size, len(g.s)::BIGINT AS n_shingles
FROM g LEFT JOIN c ON c.s = g.s LEFT JOIN comp ON comp.node = c.rep LEFT JOIN links ON links.u = c.rep
"""

#: Chunks are runs of 2 to 16 non-blank lines from a line to the next boundary, or to it from the last; lines over 50 words too.
LINE_DEDUP = r"""
WITH l AS MATERIALIZED (
  SELECT doc_id, p, lines[p] AS line, NOT regexp_full_match(lines[p], '[\x09-\x0d\x20]*') AS full_
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents WHERE text IS NOT NULL)),
g AS MATERIALIZED (SELECT *, (sum(full_::INT) OVER (PARTITION BY doc_id ORDER BY p))::BIGINT AS i FROM l),
h AS MATERIALIZED (SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 8))::BIGINT AS x FROM g WHERE full_),
c AS MATERIALIZED (SELECT *, CASE WHEN ((31 * lag(x, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) + x) & 2147483647) % 4 <> 0 THEN i END AS cut, max(i) OVER (PARTITION BY doc_id) AS n FROM h),
e AS MATERIALIZED (
  SELECT *, coalesce(min(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS nxt,
    coalesce(max(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) AS before FROM c),
runs AS MATERIALIZED (
  SELECT doc_id, i AS s, least(nxt, i + 15) AS t FROM e WHERE i < n UNION SELECT doc_id, greatest(before + 1, i - 15), i FROM e WHERE i > 1
  UNION SELECT doc_id, i, i FROM e WHERE len(list_filter(string_split_regex(line, '[\x09-\x0d\x20]+'), lambda w: w <> '')) > 50),
whole AS MATERIALIZED (SELECT doc_id, list(line ORDER BY i) AS lines FROM h GROUP BY doc_id),
body AS MATERIALIZED (SELECT doc_id, s, t, array_to_string(lines[s:t], chr(10)) AS body FROM runs JOIN whole USING (doc_id)),
f AS MATERIALIZED (SELECT body, min((doc_id, s)) AS lo FROM body GROUP BY body),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(s, t + 1)) AS i FROM body JOIN f USING (body) WHERE (doc_id, s) <> lo),
m AS MATERIALIZED (SELECT g.*, gone.i IS NOT NULL AS out_ FROM g LEFT JOIN gone ON gone.doc_id = g.doc_id AND gone.i = g.i),
r AS (SELECT doc_id, count(*) AS lines_removed, count(*) FILTER (gap) AS chunks_removed FROM (SELECT doc_id, i - lag(i, 1, -1) OVER (PARTITION BY doc_id ORDER BY i) > 1 AS gap FROM gone) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM m WHERE NOT out_ GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(lines_removed, 0)::BIGINT AS lines_removed, coalesce(chunks_removed, 0)::BIGINT AS chunks_removed
FROM documents d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH dw AS MATERIALIZED (SELECT doc_id, {WORDS} AS ws FROM documents WHERE text IS NOT NULL),
iw AS MATERIALIZED (SELECT item_id, ws, len(ws) AS m, least(5, len(ws)) AS k FROM (SELECT item_id, {WORDS} AS ws FROM benchmark WHERE text IS NOT NULL) WHERE len(ws) > 0),
ig AS MATERIALIZED (
  SELECT item_id, k, s, count(*) AS c, len(replace(s, ' ', '')) AS wt FROM (
    SELECT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM iw)) GROUP BY item_id, k, s),
ks AS (SELECT DISTINCT k FROM iw),
dg AS MATERIALIZED (
  SELECT doc_id, n, k, i, array_to_string(ws[i:i + k - 1], ' ') AS s FROM (
    SELECT doc_id, ws, len(ws) AS n, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, ks WHERE len(ws) >= k)),
starts AS MATERIALIZED (
  SELECT DISTINCT doc_id, item_id, k, m, st FROM (
    SELECT dg.doc_id, ig.item_id, dg.k, least(iw.m, dg.n) AS m, unnest(range(greatest(1, dg.i - (least(iw.m, dg.n) - dg.k)), least(dg.i, dg.n - least(iw.m, dg.n) + 1) + 1)) AS st
    FROM dg JOIN ig ON dg.s = ig.s AND dg.k = ig.k JOIN iw ON iw.item_id = ig.item_id)),
wc AS MATERIALIZED (
  SELECT t.doc_id, t.item_id, t.m, st, dg.s, count(*) AS c, len(replace(dg.s, ' ', '')) AS wt
  FROM starts t JOIN dg ON dg.doc_id = t.doc_id AND dg.k = t.k AND dg.i BETWEEN st AND st + t.m - t.k GROUP BY ALL),
sims AS (
  SELECT wc.doc_id, wc.item_id, wc.m, st, sum(wc.wt * wc.c) AS total, sum(CASE WHEN ig.s IS NULL THEN 0 ELSE wc.wt * least(wc.c, ig.c) END) AS both_
  FROM wc LEFT JOIN ig ON ig.item_id = wc.item_id AND ig.s = wc.s GROUP BY wc.doc_id, wc.item_id, wc.m, st),
tot AS (SELECT item_id, sum(wt * c) AS total FROM ig GROUP BY item_id),
scored AS (SELECT doc_id, sims.item_id, m, st, (both_ / (sims.total + tot.total - both_))::DOUBLE AS similarity FROM sims JOIN tot USING (item_id))
SELECT doc_id, item_id, (st - 1)::BIGINT AS start_word, m::BIGINT AS n_words, similarity FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, st) = 1
"""

METRIC = r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.w, reach.root FROM reach JOIN p ON p.u = reach.node),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.u = vec_id)::BIGINT AS n_links, coalesce(comp.root, vec_id)::BIGINT AS component_id, vec_id = coalesce(comp.root, vec_id) AS kept
FROM embeddings LEFT JOIN comp ON comp.node = vec_id
"""

WARC = r"""
WITH d AS (SELECT page_id, url, sha1(encode(coalesce(html, ''))) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM d)
SELECT page_id, url, payload_digest, payload_bytes, CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to FROM m
"""

#: Starts of sections, and a fingerprint, of a text's lines l with their digests g.
_STARTS = r"list_filter(range(0, len(l)), lambda i: i = 0 OR g[i + 1] < '1' OR regexp_matches(l[i + 1], '^#{1,6}\s') OR (trim(l[i]) = '' AND trim(l[i + 1]) <> ''))"
_PRINT = r"""sha256(array_to_string(list_transform(spans, lambda x: sha256(array_to_string(g[x[1]:x[2]], ','))), ';'))
  || array_to_string(list_transform(spans, lambda x: ':' || array_to_string(list_transform(l[x[1]:x[2]], lambda y: array_to_string(list_transform(regexp_extract_all(y, '[^.!?]{1,128}[.!?]*|[.!?]+'), lambda z: substr(md5(z), 1, 6)), '')), ',')), '')"""
_PIECES = "list_distinct(regexp_extract_all(substr({p}, 65), '[0-9a-f]{{6}}'))"
_NEAR = "CASE WHEN left({a}, 64) = left({b}, 64) THEN 1.0::DOUBLE WHEN len(x) + len({y}) = 0 THEN 0.0::DOUBLE ELSE least(2.0::DOUBLE * len(list_intersect(x, {y})), len(x) + len({y}) - 1.0::DOUBLE) / (len(x) + len({y}))::DOUBLE END"

MERKLE = f"""
WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS MATERIALIZED (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), (SELECT arg_min(text, doc_id) FROM t)) AS nxt, coalesce(lead(doc_id) OVER (ORDER BY doc_id), (SELECT min(doc_id) FROM t)) AS nid FROM t),
e AS MATERIALIZED (SELECT doc_id, nid, n, text, substr(text, 1, n - n // 4) || substr(nxt, 1, n // 4) AS edited FROM o),
every AS (SELECT doc_id, 0 AS kind, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
l AS MATERIALIZED (SELECT doc_id, kind, string_split(text, chr(10)) AS l FROM every),
g AS MATERIALIZED (SELECT *, list_transform(l, lambda x: sha256(x)) AS g FROM l),
s AS MATERIALIZED (SELECT *, {_STARTS} AS st FROM g),
sp AS MATERIALIZED (SELECT *, list_transform(range(1, len(st) + 1), lambda i: [st[i] + 1, coalesce(st[i + 1], len(l))]) AS spans FROM s),
f AS MATERIALIZED (SELECT doc_id, kind, {_PRINT} AS p FROM sp),
j AS MATERIALIZED (
  SELECT e.doc_id, e.nid AS next_id, e.n, e.edited, a.p AS p, b.p AS q, c.p AS r, {_PIECES.format(p='a.p')} AS x, {_PIECES.format(p='b.p')} AS y, {_PIECES.format(p='c.p')} AS z
  FROM e JOIN f a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN f b ON b.doc_id = e.doc_id AND b.kind = 1 JOIN f c ON c.doc_id = e.nid AND c.kind = 0)
SELECT doc_id, next_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, p AS fingerprint, q AS edited_fingerprint, {_NEAR.format(a='p', b='q', y='y')} AS near_edited, {_NEAR.format(a='p', b='r', y='z')} AS near_next FROM j
"""


def clusters_sql(k: int, rounds: int, dim: int, scale: int, seed: int) -> str:
    """Every distance of every round, by brute force."""
    with_ = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS q FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, q) - 1)::INTEGER AS c, q FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM v ORDER BY h, q LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        with_.append(f"a{r} AS MATERIALIZED (SELECT vec_id, q, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.q, c{r}.c, list_sum(list_transform(list_zip(v.q, c{r}.q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM v, c{r}) GROUP BY vec_id, q)")
        if r < rounds:
            with_.append(f"s{r} AS MATERIALIZED (SELECT c, list(m ORDER BY i) AS q FROM (SELECT c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c)")
            with_.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(s{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN s{r} USING (c))")
    return "WITH " + ",\n".join(with_) + f"""
SELECT vec_id, a{rounds}.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = a{rounds}.c"""


ORACLES = {"op12_merkle": MERKLE, "op13_elkan": clusters_sql(40, 5, 64, 256, 2), "op5_warc": WARC, "op7_metric_join": METRIC, "op4_ngram_jaccard": JACCARD, "op9_line_dedup": LINE_DEDUP, "op10_decontamination": DECONTAMINATION}
