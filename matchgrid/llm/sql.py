"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from matchgrid.llm.licence_rules import CONFIDENCE, rules

SHARDS = """
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT), 32, '0') AS bits FROM documents
), s AS (
  SELECT depth, left(bits, depth) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
  FROM d, (SELECT unnest(range(33))::INT AS depth) GROUP BY 1, 2
), fit AS (SELECT * FROM s WHERE shard_bytes <= 1048576 OR shard_docs = 1)
SELECT doc_id, n_bytes, shard, depth, shard_bytes, shard_docs
FROM d JOIN fit ON left(d.bits, fit.depth) = fit.shard
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS sh FROM w
), n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
c AS (SELECT md5(array_to_string(list_sort(sh), '|')) AS cls, min(doc_id) AS rep, any_value(sh) AS sh, any_value(len(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY 1),
e AS (SELECT rep, n, unnest(list_transform(sh, lambda s: hash(s))) AS x FROM c),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
comp AS (SELECT a AS rep, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, n.n_shingles, coalesce(comp.component_id, c.rep, n.doc_id) AS component_id
FROM n JOIN s USING (doc_id) LEFT JOIN c ON c.cls = md5(array_to_string(list_sort(s.sh), '|')) AND len(s.sh) > 0 LEFT JOIN comp ON comp.rep = c.rep
"""


LEAKS = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, width, array_to_string(ws[i:i + width - 1], ' ') AS phrase FROM (
    SELECT item_id, ws, least(10, len(ws)) AS width, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0 AND item_id IS NOT NULL)
), hit AS (
  SELECT r, i, g.width, item_id FROM (
    SELECT r, width, i, array_to_string(ws[i:i + width - 1], ' ') AS phrase
    FROM (SELECT r, ws, width, unnest(range(1, len(ws) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM win))) g
  JOIN win ON win.width = g.width AND win.phrase = g.phrase
), covered AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + width)) AS place FROM hit) GROUP BY r),
which AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN which USING (r)
"""


def _clusters() -> str:
    """Three rounds of assignment and update, then one more assignment, written out one below the other."""
    parts = ["""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), r) - 1 AS number, x AS m FROM v QUALIFY number < 16
)"""]
    for i in range(4):
        parts.append(f"""a{i} AS (
  SELECT r, arg_min(number, (far, number)) AS cluster, min(far) AS distance FROM (
    SELECT r, number, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far FROM v, c{i}) GROUP BY r
)""")
        if i < 3:
            parts.append(f"""c{i + 1} AS (
  SELECT number, coalesce(new, m) AS m FROM c{i} LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS new FROM (
      SELECT cluster, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM v JOIN a{i} USING (r), (SELECT unnest(range(1, 65)) AS j) GROUP BY cluster, j) GROUP BY cluster
  ) ON cluster = number
)""")
    return ",\n".join(parts) + """
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(m, lambda x: x::VARCHAR), ',')) AS centroid_sha256
FROM v JOIN a3 USING (r) JOIN c3 ON number = cluster
"""


CLUSTERS = _clusters()

NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (SELECT anchor, other AS positive, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.positive AS positive_id, (row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.other))::INT AS rank,
  s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""


def _licences() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ",\n".join(f"({i}, {p}, {quote(label)}, {quote(k)}, {quote(x)})" for i, p, label, k, x in rules())
    sure = ", ".join(map(str, CONFIDENCE))
    return rf"""
WITH r(rule, priority, label, keyword, pattern) AS (VALUES {table}),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(low, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM d),
ph(words, tag) AS (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')),
hit AS (
  SELECT doc_id, tag, pos - 1 AS place FROM (SELECT doc_id, ws, words, tag, unnest(range(1, len(ws) + 1)) AS pos FROM w, ph WHERE list_has_all(ws, words))
  WHERE ws[pos:pos + len(words) - 1] = words
), base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT tag) AS tags FROM hit GROUP BY 1),
m AS (
  SELECT doc_id, rule, priority, label, regexp_extract_all(low, pattern) AS found, regexp_split_to_array(low, pattern) AS between
  FROM d JOIN r ON contains(low, keyword) WHERE regexp_matches(low, pattern)
), det AS (
  SELECT doc_id, rule, priority, label, start, start + len(found[i]) AS stop FROM (
    SELECT *, list_sum(list_transform(between[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0) AS start
    FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m))
), kept AS (
  SELECT * FROM det d WHERE NOT EXISTS (
    SELECT 1 FROM det e WHERE e.doc_id = d.doc_id AND (
      (e.start <= d.start AND e.stop >= d.stop AND (e.priority < d.priority OR (e.priority = d.priority AND (e.stop - e.start > d.stop - d.start OR e.rule < d.rule))))
      OR (d.start <= e.start AND d.stop >= e.stop AND e.priority < d.priority)))
), own AS (SELECT doc_id, list(DISTINCT label) AS labels, max([{sure}][priority + 1])::DOUBLE AS sure FROM kept GROUP BY 1)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(tags), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(tags, []), coalesce(labels, [])))), ',') AS labels,
  greatest(coalesce(sure, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""


LICENCES = _licences()
