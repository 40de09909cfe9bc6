"""DuckDB SQL for the operators that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op2_url_filters"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM cut),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'allow'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT DISTINCT host, path, h || p AS rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, length(h) DESC) AS n
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, parts.host AS host, parts.path AS path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.host = fits.host AND parts.path = fits.path AND n = 1
"""

ORACLE["op4_substring_dedup"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place, len(words) AS n FROM split),
windows AS (
  SELECT doc_id, i AS start, array_to_string(words[i:i + 19], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM split)),
repeats AS (
  SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM repeats),
kept AS (
  SELECT placed.doc_id, string_agg(word, ' ' ORDER BY placed.place) AS text, count(*) AS n
  FROM placed LEFT JOIN gone ON placed.doc_id = gone.doc_id AND placed.place = gone.place WHERE gone.doc_id IS NULL GROUP BY 1)
SELECT split.doc_id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept ON split.doc_id = kept.doc_id
"""

ORACLE["op11_hard_negatives"] = r"""
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM used a, used r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER own AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW own AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY rank <= 5
"""
