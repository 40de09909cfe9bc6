"""SQL for the queries of ``catalog_text``."""

from __future__ import annotations

from colloquy import vocab
from colloquy.plans.oracle import ORACLE, _add, _list
from colloquy.sources import driver_tables as src

WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = rf"[^{WS}]+"


def strip(t):
    return f"regexp_replace({t}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def norm(t):
    out = f"regexp_replace({t}, '\\r\\n?', chr(10), 'g')"
    out = f"regexp_replace({out}, '[ \\t]+\\n', chr(10), 'g')"
    return strip(f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def words(t):
    return f"len(regexp_extract_all({t}, '{WORD}'))"


def match_norm(t):
    squeezed = f"regexp_replace(lower({t}), '[{WS}]+', ' ', 'g')"
    return f"trim(regexp_replace({squeezed}, '[^a-z0-9 ]+', ' ', 'g'))"


def cut_cte(name, table, key, text, limit):
    """CTE with the sentence cut of a text column as ``summary``."""
    return f"""{name}_s AS (
  SELECT {key}, {text} AS whole, str_split(regexp_replace({strip(text)}, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1)) AS sents
  FROM {table}
),
{name}_c AS (
  SELECT *, list_transform(sents, lambda s: {words('s')}) AS counts FROM {name}_s
),
{name}_k AS (
  SELECT *, len(list_filter(range(1, least(len(sents), {limit} + 1) + 1), lambda i: list_sum(counts[1:i]) <= {limit})) AS kept
  FROM {name}_c
),
{name} AS (
  SELECT {key}, whole, CASE WHEN kept > 0 THEN array_to_string(sents[1:kept], ' ')
         ELSE array_to_string(regexp_extract_all(whole, '{WORD}')[1:{limit}], ' ') END AS summary
  FROM {name}_k
)"""


def digest(t, ctes=""):
    return f"SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, {t} AS t FROM documents)"


_add("text_normalize", digest(norm("replace(text, chr(10), ' ' || chr(9) || chr(13) || chr(10) || chr(13) || chr(10) || chr(10))")), prelude=False)
_add("usable_text", """
SELECT doc_id, length(whole) >= 200 AND NOT (length(body) < 200 AND contains(lower(body), 'see attached') AND length(whole) = length(body)) AS usable
FROM (SELECT *, CASE WHEN doc_id % 20 = 0 THEN body || chr(10) || chr(10) || text ELSE body END AS whole
      FROM (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'Please see attached file.' ELSE text END AS body FROM documents))""", prelude=False)
_add("content_hash", "SELECT doc_id, substr(sha256(text || chr(0)), 1, 16) AS content_hash, "
     "substr(sha256(source || chr(0) || text || chr(0)), 1, 16) AS sourced_hash FROM documents", prelude=False)
_add("word_count", f"SELECT doc_id, {words('text')} AS words FROM documents", prelude=False)
_add("sentence_cut", f"SELECT doc_id, summary, {words('whole')} > 45 AS cut FROM cut",
     cut_cte("cut", "documents", "doc_id", "text", 45), prelude=False)
KEY = "substr(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), 1, 160)"
_add("passage_key", f"SELECT doc_id, {KEY.format('text')} AS passage_key FROM documents", prelude=False)
_add("match_norm", digest(match_norm("text")), prelude=False)
_add("slug", "SELECT doc_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) "
     "AS slug FROM documents", prelude=False)
_dash = "replace(replace(replace(replace(text, ', ', ' ' || chr(8212) || ' '), '; ', ' ' || chr(8211) || ' '), chr(8212), ', '), chr(8211), ', ')"
_clean = f"regexp_replace({strip(_dash)}, '[{WS}]*[\\r\\n]+[{WS}]*', ', ', 'g')"
_clean = f"regexp_replace({_clean}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
_clean = f"regexp_replace(regexp_replace({_clean}, '[{WS}]+', ' ', 'g'), ' +,', ',', 'g')"
_clean = f"regexp_replace(regexp_replace({_clean}, ',( *,)+', ',', 'g'), '([:;,]) *,', '\\1', 'g')"
_add("text_cleanup", f"SELECT doc_id, md5({strip(_clean)}) AS digest, "
     "regexp_matches(text, '[\\r\\n\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') AS broken FROM documents", prelude=False)
_add("chunk_plan", f"""
SELECT doc_id, i + 1 AS chunk_index, n AS chunk_total, i * {vocab.CHUNK_CHARS - vocab.CHUNK_OVERLAP_CHARS} AS start,
       md5(substr(text, i * {vocab.CHUNK_CHARS - vocab.CHUNK_OVERLAP_CHARS} + 1, {vocab.CHUNK_CHARS})) AS digest
FROM (SELECT doc_id, text, n, unnest(range(n)) AS i FROM (
  SELECT doc_id, text, CASE WHEN length(text) <= {vocab.CHUNK_CHARS} THEN 1::BIGINT ELSE
    CAST(ceil((length(text) - {vocab.CHUNK_OVERLAP_CHARS}) / {float(vocab.CHUNK_CHARS - vocab.CHUNK_OVERLAP_CHARS)}) AS BIGINT) END AS n
  FROM documents))""", prelude=False)
_add("txt_decode", f"""
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unsupported' WHEN t = '' THEN 'error' ELSE 'ok' END AS status,
       md5(CASE WHEN doc_id % 7 = 0 THEN '' ELSE t END) AS digest,
       CASE WHEN doc_id % 7 = 0 THEN 'unsupported format .pdf' WHEN t = '' THEN 'no extractable text (scanned image?)' END AS error
FROM (SELECT doc_id, {norm('text')} AS t FROM documents)""", prelude=False)
_add("assembled_text", f"""
SELECT comment_id, md5(text) AS digest, substr(sha256(text || chr(0)), 1, 16) AS content_hash, length(body) AS body_chars,
       length(text) AS total_chars, usable, CASE WHEN NOT usable THEN 'no usable text extracted' END AS exclusion_reason
FROM (
  SELECT *, length(text) >= 200 AND NOT (length(body) < 200 AND length(text) = length(body) AND
    (contains(lower(body), 'see attached') OR contains(lower(body), 'see attachment') OR contains(lower(body), 'attached please find'))) AS usable
  FROM (
    SELECT comment_id, body, CASE WHEN body <> '' AND parts IS NOT NULL THEN body || chr(10) || chr(10) || parts
                                  ELSE coalesce(nullif(body, ''), parts, '') END AS text
    FROM (SELECT conv_id AS comment_id, {norm('text')} AS body FROM conversations WHERE turn = 0)
    LEFT JOIN (
      SELECT conv_id AS comment_id, string_agg('[Attachment: ' || CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) ELSE role END || ']' || chr(10) || text,
             chr(10) || chr(10) ORDER BY turn) AS parts
      FROM conversations WHERE turn > 0 AND turn % 5 <> 4 GROUP BY 1) USING (comment_id)))""", prelude=False)
_add("attachment_flatten", """
SELECT CAST(page_id AS VARCHAR) AS comment_id, 'a' || page_id AS attachment_id, url AS title, format,
       size, file_url, ext AS extension, page_id || '/a' || page_id || ext AS local_path
FROM (SELECT page_id, url, 'PDF' AS format, length(html) AS size, url || '/f.PDF' AS file_url, '.pdf' AS ext FROM pages
      UNION ALL SELECT page_id, url, NULL, NULL, url || '/g.DocX', '.docx' FROM pages
      UNION ALL SELECT page_id, url, 'txt', 1, url, '.txt' FROM pages WHERE page_id % 3 <> 0) WHERE page_id % 7 <> 0""", prelude=False)

# --- passages ---------------------------------------------------------------
LINES = """lines AS (
  SELECT doc_id, lang, generate_subscripts(ls, 1) - 1 AS ord, unnest(ls) AS line
  FROM (SELECT doc_id, lang, str_split(text, chr(10)) AS ls FROM documents)
)"""
SEGMENTS = f"""{LINES},
found AS (
  SELECT CAST(doc_id AS VARCHAR) AS comment_id, ord, {strip('line')} AS passage, {strip('substr(line, 1, 40)')} AS gist,
         list_filter(list_distinct([(doc_id + ord) % 30, (doc_id * 7 + ord) % 26 + 1]), lambda q: q BETWEEN 1 AND 26) AS qs
  FROM lines WHERE (doc_id + ord) % 11 <> 0
),
keyed AS (
  SELECT *, {KEY.format('passage')} AS k FROM found WHERE len(qs) > 0 AND length(passage) >= 40
),
first_seen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY comment_id, k ORDER BY ord) AS rn FROM keyed) WHERE rn = 1
),
questions_of AS (
  SELECT comment_id, k, string_agg('q' || q, ',' ORDER BY q) AS question_ids
  FROM (SELECT DISTINCT comment_id, k, unnest(qs) AS q FROM keyed) GROUP BY 1, 2
),
merged AS (SELECT comment_id, ord AS first_ord, question_ids, passage, gist FROM first_seen JOIN questions_of USING (comment_id, k))"""
_add("segment_dedupe", "SELECT comment_id, first_ord, question_ids, md5(passage) AS digest, gist AS position_gist FROM merged",
     SEGMENTS, prelude=False)
_add("segment_ids", "SELECT comment_id, 'seg-' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS segment_id, "
     "question_ids, md5(passage) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY first_ord) AS n FROM merged)",
     SEGMENTS, prelude=False)
_add("stakeholder_coercion", "SELECT CASE WHEN CAST(comment_id AS BIGINT) % 3 = 0 THEN 'other' ELSE stakeholder_type END AS stakeholder_type, "
     "count(*) AS n FROM cand GROUP BY 1")

# --- labels -----------------------------------------------------------------
_issues, _gaps = _list(vocab.ISSUES), _list(vocab.GAPS)
SEG_ID = ("lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || l_partkey || '-' || l_suppkey || '-' || "
          "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)")
SCORED = f"""scored AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS comment_id, {SEG_ID} AS segment_id, CAST(l_quantity AS INTEGER) AS qty, p_name, p_size,
         l_partkey % 30 AS q1, l_suppkey % 26 + 1 AS q2,
         CAST(substr(p_brand, 7) AS INTEGER) AS brand,
         {_gaps}[l_suppkey % 9 + 1] AS g1, {_gaps}[l_partkey % 9 + 1] AS g2, {_gaps}[(l_partkey + 4) % 9 + 1] AS g3,
         {_gaps}[(l_partkey + 6) % 9 + 1] AS g4
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
),
typed AS (
  SELECT *, CASE WHEN p_size % 7 = 0 THEN 'regulatory_scope' ELSE {_issues}[brand % 21 + 1] END AS primary_issue,
         {_issues}[(brand + qty % 2) % 21 + 1] AS second_issue,
         CASE WHEN g2 = g1 THEN [g1, g3, g4] WHEN g3 = g1 THEN [g1, g2, g4] ELSE [g1, g2, g3] END AS tags
  FROM scored
)"""
_add("analysis_coercion", """
SELECT comment_id, segment_id,
       CASE WHEN qty % 4 = 0 OR q1 = q2 OR q1 NOT BETWEEN 1 AND 26 THEN 'q' || q2
            ELSE 'q' || least(q1, q2) || ',q' || greatest(q1, q2) END AS question_ids,
       primary_issue, CASE WHEN second_issue <> primary_issue THEN second_issue END AS secondary_issue,
       p_name AS stakeholder_concern, '' AS requested_fda_action, 'low' AS confidence,
       array_to_string(tags, ',') AS gap_tags,
       tags[1] || ':' || p_name || ';' || tags[2] || ':;' || tags[3] || ':' AS gap_explanations,
       CASE WHEN qty > 15 THEN rtrim(repeat(p_name || ' notes. ', 15)) ELSE repeat(p_name || ' notes. ', qty) END AS public_summary,
       qty > 15 AS summary_cut
FROM typed""", SCORED, prelude=False)
_add("summary_limit", f"SELECT doc_id, md5(CASE WHEN {words('whole')} > 60 THEN summary ELSE whole END) AS digest, {words('whole')} > 60 AS cut FROM cut",
     f"bare AS (SELECT doc_id, regexp_replace({strip('text')}, '^\"+|\"+$', '', 'g') AS text FROM documents), "
     + cut_cte("cut", "bare", "doc_id", "text", 60), prelude=False)
_add("label_fill", f"""
SELECT comment_id, segment_id, CASE WHEN ok THEN given ELSE 'no_clear_answer' END AS response_type, NOT ok AS defaulted
FROM (SELECT *, coalesce(given IN {tuple(vocab.RESPONSE_TYPES)}, FALSE) AS ok FROM (
  SELECT comment_id, segment_id,
         CASE WHEN CAST(substr(segment_id, 1, 2) AS INTEGER) % 4 = 0 THEN CASE WHEN confidence = 'low' THEN 'bogus' ELSE 'concern' END
              WHEN CAST(substr(segment_id, 1, 2) AS INTEGER) % 3 <> 0 THEN response_type END AS given
  FROM raw_pos))""")
_add("answer_parsing", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, "
     "event_id % 5 = 0 AS malformed FROM events", prelude=False)
_add("label_representations", """
SELECT comment_id, segment_id,
       md5(segment_id || ' | stance=' || position || ' | summary: ' || public_summary || ' | concern: ' || stakeholder_concern ||
           ' | asks FDA to: ' || requested_fda_action) AS compact,
       md5(segment_id || ' | stance=' || position || ' | ' || public_summary) AS summary,
       md5('{"segment_id":"' || segment_id || '","question_ids":["' || array_to_string(question_ids, '","') || '"],"stance":"' || position ||
           '","summary":"' || public_summary || '","concern":"' || stakeholder_concern || '","requested_fda_action":"' || requested_fda_action || '"}') AS "full"
FROM raw_pos""")
_add("touching_questions", "SELECT comment_id, segment_id FROM raw_pos WHERE comment_id IN "
     "(SELECT comment_id FROM raw_pos WHERE list_has_any(question_ids, ['q1', 'q13']))")
_add("scored_rows", "SELECT comment_id, segment_id, ['direct_answer', 'recommendation', 'concern'][length(public_summary) % 3 + 1] "
     "AS response_type FROM raw_pos")

# --- near-duplicates --------------------------------------------------------
_stance = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in src.LANG_STANCE.items()) + " ELSE 'unclear' END"
PASSAGES = f"""{LINES},
told AS (
  SELECT CAST(doc_id AS VARCHAR) AS sub,
         'seg-' || lpad(CAST(ord + 1 AS VARCHAR), CAST(greatest(3, length(CAST(ord + 1 AS VARCHAR))) AS INTEGER), '0') AS seg,
         list_distinct([doc_id % 26 + 1, length(line) % 26 + 1]) AS qs, {_stance} AS stance, ord % 3 AS conf,
         list_slice([{_gaps}[length(line) % 9 + 1], {_gaps}[(length(line) + 2) % 9 + 1], {_gaps}[(length(line) + 5) % 9 + 1]],
                    1, CAST(ord % 4 AS INTEGER)) AS tags,
         line, {match_norm('line')} AS passage
  FROM lines WHERE length(line) >= 40
)"""
# Passage containment in relational form.  Grams of 20 characters that two
# passages share line up on diagonals; consecutive ones form maximal runs; the
# longest run is taken, then the stretches left and right of it, recursively.
CONTAINED = f"""{PASSAGES},
grams AS (
  SELECT sub, seg, unnest(range(length(passage) - 19)) AS pos, passage FROM told WHERE length(passage) >= 20
),
cut_grams AS (SELECT sub, seg, pos, substr(passage, pos + 1, 20) AS gram FROM grams),
twins AS (
  SELECT a.sub, a.seg AS x, b.seg AS y FROM told a JOIN told b ON a.sub = b.sub AND a.stance = b.stance AND a.seg < b.seg
  WHERE list_has_any(a.qs, b.qs)
),
sized AS (
  SELECT t.sub, t.x, t.y, CASE WHEN length(a.passage) <= length(b.passage) THEN t.x ELSE t.y END AS s,
         CASE WHEN length(a.passage) <= length(b.passage) THEN t.y ELSE t.x END AS l,
         least(length(a.passage), length(b.passage)) AS n, greatest(length(a.passage), length(b.passage)) AS m
  FROM twins t JOIN told a ON a.sub = t.sub AND a.seg = t.x JOIN told b ON b.sub = t.sub AND b.seg = t.y
),
hits AS (
  SELECT z.sub, z.x, z.y, g.pos AS i, h.pos AS j
  FROM cut_grams g JOIN cut_grams h ON g.sub = h.sub AND g.gram = h.gram
  JOIN sized z ON z.sub = g.sub AND z.s = g.seg AND z.l = h.seg
),
islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY sub, x, y, i - j ORDER BY i) AS island FROM hits
),
runs AS (
  SELECT sub, x, y, min(i) AS i, min(j) AS j, count(*) + 19 AS k FROM islands GROUP BY sub, x, y, i - j, island
)"""
CLUSTERS = f"""{CONTAINED},
steps AS (
  SELECT sub, x, y, 0::BIGINT AS alo, n AS ahi, 0::BIGINT AS blo, m AS bhi, 0::BIGINT AS got FROM sized
  WHERE (sub, x, y) IN (SELECT (sub, x, y) FROM runs)
  UNION ALL
  SELECT b.sub, b.x, b.y,
         CASE side WHEN 1 THEN best.i + best.k ELSE alo END, CASE side WHEN 0 THEN best.i ELSE ahi END,
         CASE side WHEN 1 THEN best.j + best.k ELSE blo END, CASE side WHEN 0 THEN best.j ELSE bhi END,
         CASE side WHEN 2 THEN best.k ELSE 0 END
  FROM (
    SELECT sub, x, y, alo, ahi, blo, bhi, arg_max({{'i': i, 'j': j, 'k': k}}, {{'k': k, 'i': -i, 'j': -j}}) AS best
    FROM (
      SELECT s.sub, s.x, s.y, s.alo, s.ahi, s.blo, s.bhi,
             r.i + greatest(0, s.alo - r.i, s.blo - r.j) AS i, r.j + greatest(0, s.alo - r.i, s.blo - r.j) AS j,
             least(r.k, s.ahi - r.i, s.bhi - r.j) - greatest(0, s.alo - r.i, s.blo - r.j) AS k
      FROM steps s JOIN runs r ON r.sub = s.sub AND r.x = s.x AND r.y = s.y
      WHERE s.got = 0
    ) c WHERE k >= 20
    GROUP BY sub, x, y, alo, ahi, blo, bhi
  ) b, (VALUES (0), (1), (2)) AS v(side)
),
near AS (
  SELECT sub, x, y FROM (SELECT sub, x, y, sum(got) AS covered FROM steps GROUP BY 1, 2, 3) JOIN sized USING (sub, x, y)
  WHERE covered / n >= 0.5995
),
edges AS (SELECT sub, x AS a, y AS b FROM near UNION SELECT sub, y, x FROM near),
reach AS (
  SELECT DISTINCT sub, a AS seg, a AS other FROM edges
  UNION
  SELECT r.sub, r.seg, e.b FROM reach r JOIN edges e ON e.sub = r.sub AND e.a = r.other
),
members AS (SELECT sub, seg, min(other) AS root FROM reach GROUP BY 1, 2)"""
_rec = "WITH RECURSIVE " + CLUSTERS
ORACLE["dup_passage_clusters"] = _rec + "\nSELECT sub AS submission_id, seg AS segment_id, root AS root_segment FROM members"
RANKED = (
    ", " + cut_cte("cut", "told", "sub, seg", "line", 45).replace("SELECT sub, seg, line AS whole", "SELECT sub, seg, line AS whole")
    + """,
ranked AS (
  SELECT t.sub, t.seg, m.root, t.qs, t.tags, t.stance,
         row_number() OVER (PARTITION BY t.sub, m.root ORDER BY t.conf, length(t.line) DESC, len(t.tags) DESC, length(c.summary) DESC, t.seg) AS place
  FROM told t JOIN members m USING (sub, seg) JOIN cut c USING (sub, seg)
),
kept AS (SELECT sub, root, seg FROM ranked WHERE place = 1),
kept_questions AS (
  SELECT sub, root, string_agg('q' || q, ',' ORDER BY q) AS question_ids
  FROM (SELECT DISTINCT sub, root, unnest(qs) AS q FROM ranked) GROUP BY 1, 2
),
tag_first AS (
  SELECT * FROM (
    SELECT sub, root, tag, place, ix, seg, row_number() OVER (PARTITION BY sub, root, tag ORDER BY place, ix) AS rn
    FROM (SELECT sub, root, place, seg, unnest(tags) AS tag, generate_subscripts(tags, 1) AS ix FROM ranked)) WHERE rn = 1
),
kept_tags AS (
  SELECT sub, root, string_agg(tag, ',' ORDER BY place, ix) AS tags, string_agg(tag || ':' || seg || ' on ' || tag, ';' ORDER BY place, ix) AS told
  FROM (SELECT *, row_number() OVER (PARTITION BY sub, root ORDER BY place, ix) AS n FROM tag_first) WHERE n <= 3 GROUP BY 1, 2
)""")
ORACLE["dup_survivors"] = _rec + RANKED + """
SELECT sub AS submission_id, k.seg AS kept_segment_id, n - 1 AS merged, question_ids, stance AS position
FROM kept k JOIN (SELECT sub, root, count(*) AS n, any_value(stance) AS stance FROM ranked GROUP BY 1, 2) USING (sub, root)
JOIN kept_questions USING (sub, root)"""
ORACLE["dup_merged"] = _rec + RANKED + """
SELECT t.sub AS submission_id, t.seg AS segment_id,
       CASE WHEN k.seg IS NOT NULL THEN question_ids
            ELSE (CASE WHEN t.d = t.c THEN 'q' || t.d ELSE 'q' || t.d || ',q' || t.c END) END AS question_ids,
       coalesce(CASE WHEN k.seg IS NOT NULL AND kt.tags IS NOT NULL THEN kt.tags ELSE array_to_string(t.tags, ',') END, '') AS gap_tags,
       coalesce(CASE WHEN k.seg IS NOT NULL AND kt.told IS NOT NULL THEN kt.told
            ELSE array_to_string(list_transform(t.tags, lambda g: g || ':' || t.seg || ' on ' || g), ';') END, '') AS gap_explanations
FROM (SELECT *, CAST(sub AS BIGINT) % 26 + 1 AS d, length(line) % 26 + 1 AS c FROM told) t
LEFT JOIN members m USING (sub, seg)
LEFT JOIN kept k ON k.sub = t.sub AND k.seg = t.seg
LEFT JOIN kept_questions q ON q.sub = t.sub AND q.root = m.root
LEFT JOIN kept_tags kt ON kt.sub = t.sub AND kt.root = m.root
WHERE m.root IS NULL OR k.seg IS NOT NULL"""
ORACLE["dup_provenance"] = _rec + RANKED + """
SELECT r.sub AS submission_id, k.seg AS kept_segment_id, r.seg AS merged_segment_id
FROM ranked r JOIN kept k USING (sub, root) WHERE r.seg <> k.seg"""
ORACLE["consolidation_counts"] = _rec + """
SELECT count(DISTINCT sub) AS submissions_affected, count(DISTINCT (sub, root)) AS clusters,
       count(*) - count(DISTINCT (sub, root)) AS positions_merged FROM members"""
_add("dup_candidate_counts", """
SELECT a.sub AS submission_id, count(*) AS pairs FROM told a JOIN told b ON a.sub = b.sub AND a.stance = b.stance AND a.seg < b.seg
WHERE list_has_any(a.qs, b.qs) GROUP BY 1""", PASSAGES, prelude=False)
