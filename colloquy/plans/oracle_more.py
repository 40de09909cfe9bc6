"""SQL for the queries of ``catalog_more``."""

from __future__ import annotations

from colloquy import vocab
from colloquy.plans.oracle import ORACLE, _add, _list
from colloquy.plans.catalog_more import EARLY

# --- freshness --------------------------------------------------------------
STORED = """inputs AS (SELECT CAST(o_orderkey AS VARCHAR) AS comment_id, o_orderkey AS k, substr(md5(o_orderstatus), 1, 16) AS input_hash FROM orders),
flags AS (SELECT comment_id, input_hash, k % 10 <> 0 AND k % 9 <> 0 AND k % 8 <> 0 AND k % 7 <> 0 AS fresh FROM inputs)"""
_add("freshness_flags", "SELECT comment_id, fresh FROM flags", STORED, prelude=False)
_add("pending_rows", "SELECT comment_id, input_hash FROM flags WHERE NOT fresh", STORED, prelude=False)
_add("pending_counts", "SELECT count(*) FILTER (fresh) AS fresh, count(*) FILTER (NOT fresh) AS pending FROM flags", STORED, prelude=False)
NEWEST = """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1),
stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'click') WHERE rn = 1)"""
_add("latest_version", "SELECT user_id AS comment_id, event_id, event_type FROM newest", NEWEST, prelude=False)
_add("changed_comments", "SELECT n.user_id AS comment_id, n.event_id FROM newest n LEFT JOIN stored s USING (user_id) "
     "WHERE s.user_id IS NULL OR s.ts <> n.ts", NEWEST, prelude=False)
_add("text_refresh", "SELECT CAST(o_orderkey AS VARCHAR) AS comment_id FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 4 = 0", prelude=False)
_add("record_hash", "SELECT p_partkey, substr(sha256('{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || '\",\"p_brand\":\"' || p_brand || "
     "'\"}' || chr(0)), 1, 16) AS record_hash FROM part", prelude=False)
_add("fresh_response_types", "SELECT CASE WHEN CAST(comment_id AS BIGINT) % 5 <> 0 THEN response_type END AS response_type, count(*) AS n "
     "FROM raw_pos GROUP BY 1")


# --- changes ----------------------------------------------------------------
def snap(x, condition):
    return f"""{x}_rows AS (SELECT q.* FROM qrows q JOIN subs s USING (submission_id) WHERE {condition}),
{x}_c AS (
  SELECT question_id, count(DISTINCT commenter_id) AS n, count(*) AS positions, list_sort(list(DISTINCT stakeholder_type)) AS groups,
         list_sort(list(DISTINCT primary_issue || '|' || coalesce(response_type, 'unknown'))) AS combos
  FROM {x}_rows GROUP BY 1
),
{x}_i AS (SELECT question_id, primary_issue AS issue, count(DISTINCT commenter_id) AS n FROM {x}_rows GROUP BY 1, 2),
{x}_m AS (SELECT question_id, string_agg(issue || ':' || n, ';' ORDER BY issue) AS issues FROM {x}_i GROUP BY 1),
{x}_t AS (
  SELECT question_id, id AS dominant FROM (
    SELECT question_id, v.id, row_number() OVER (PARTITION BY question_id ORDER BY count(DISTINCT commenter_id) DESC, any_value(ordinal)) AS rn
    FROM {x}_rows JOIN v_type v ON v.id = coalesce(response_type, 'unknown') GROUP BY question_id, v.id) WHERE rn = 1
),
{x} AS (
  SELECT q.question_id, q.question_number, coalesce(n, 0) AS n, coalesce(groups, []) AS groups, coalesce(combos, []) AS combos,
         coalesce(issues, '') AS issues, dominant, coalesce(n % 2 = 1, FALSE) AS disagrees, coalesce(n % 3 = 0, FALSE) AS divided,
         CASE WHEN n IS NULL THEN 'pending' WHEN positions % 4 = 0 THEN 'stale' ELSE 'generated' END AS status
  FROM questions q LEFT JOIN {x}_c USING (question_id) LEFT JOIN {x}_m USING (question_id) LEFT JOIN {x}_t USING (question_id)
)"""


NEW, OLD = snap("cur", "TRUE"), snap("old", f"received_date < '{EARLY}'")
_add("snapshot", "SELECT question_id, n AS distinct_commenters, array_to_string(groups, ',') AS stakeholder_groups, issues AS issue_commenters, "
     "array_to_string(combos, ',') AS combos, dominant AS dominant_response_type, disagrees AS disagreement_exists, status AS synthesis_status FROM cur", NEW)
_add("snapshot_commenters", "SELECT DISTINCT question_id, commenter_id FROM qrows")
_add("change_queue", """
SELECT question_id, question_number, concat_ws(',', r1, r2, r3, r4, r5, r6, r8) AS reasons, concat_ws('; ', d1, d2, d3, d4, d5, d6, d8) AS what_changed,
       o_n AS prior_distinct_commenters, n AS new_distinct_commenters, array_to_string(g, ',') AS new_stakeholder_groups,
       TRUE AS curated_read_may_need_review
FROM (
  SELECT *,
    CASE WHEN len(g) > 0 THEN 'new_stakeholder_group' END AS r1, CASE WHEN len(g) > 0 THEN 'new group(s): ' || array_to_string(g, ', ') END AS d1,
    CASE WHEN len(c) > 0 THEN 'new_substantive_position' END AS r2,
    CASE WHEN len(c) > 0 THEN 'new issue and response-type combination(s): ' || replace(array_to_string(c, ', '), '|', ' / ') END AS d2,
    CASE WHEN ok AND o_dom <> dominant THEN 'dominant_response_type_changed' END AS r3, CASE WHEN ok AND o_dom <> dominant THEN o_dom || ' -> ' || dominant END AS d3,
    CASE WHEN ok AND o_dis <> disagrees THEN CASE WHEN disagrees THEN 'disagreement_emerged' ELSE 'disagreement_resolved' END END AS r4,
    CASE WHEN ok AND o_dis <> disagrees THEN 'about: scope' END AS d4,
    CASE WHEN ok AND o_div <> divided THEN 'stakeholder_divide_changed' END AS r5,
    CASE WHEN ok AND o_div <> divided THEN 'a stakeholder divide is now ' || CASE WHEN divided THEN 'reported' ELSE 'no longer supported' END END AS d5,
    CASE WHEN ok AND x IS NOT NULL THEN 'issue_crossed_threshold' END AS r6,
    CASE WHEN ok AND x IS NOT NULL THEN x || ' now raised by at least 5 distinct commenters' END AS d6,
    CASE WHEN ok AND status = 'stale' AND o_status <> 'stale' THEN 'synthesis_stale' END AS r8,
    CASE WHEN ok AND status = 'stale' AND o_status <> 'stale' THEN 'positions changed since the synthesis was generated' END AS d8
  FROM (
    SELECT cur.*, old.n AS o_n, old.dominant AS o_dom, old.disagrees AS o_dis, old.divided AS o_div, old.status AS o_status,
           old.status <> 'pending' AND cur.status <> 'pending' AS ok,
           list_filter(cur.groups, lambda v: NOT list_contains(old.groups, v)) AS g,
           CASE WHEN len(list_filter(old.combos, lambda v: NOT ends_with(v, '|unknown'))) > 0
                THEN list_filter(cur.combos, lambda v: NOT list_contains(old.combos, v))
                ELSE list_filter(cur.combos, lambda v: NOT list_contains(list_transform(old.combos, lambda w: split_part(w, '|', 1)), split_part(v, '|', 1))) END AS c,
           x
    FROM cur JOIN old USING (question_id)
    LEFT JOIN (SELECT i.question_id, string_agg(i.issue, ', ' ORDER BY i.issue) AS x FROM cur_i i
               LEFT JOIN old_i j ON j.question_id = i.question_id AND j.issue = i.issue
               WHERE i.n >= 5 AND coalesce(j.n, 0) < 5 GROUP BY 1) crossed ON crossed.question_id = cur.question_id
  ))
WHERE concat_ws(',', r1, r2, r3, r4, r5, r6, r8) <> ''""", NEW + ",\n" + OLD)

# --- comparison -------------------------------------------------------------
RUNS = """pairs AS (
  SELECT comment_id, segment_id, production, shadow, question_ids FROM (
    SELECT *, response_type AS production,
           CASE WHEN confidence = 'low' THEN 'concern' WHEN confidence = 'medium' THEN 'recommendation' ELSE response_type END AS shadow
    FROM raw_pos WHERE substr(segment_id, 1, 2) <> '07' AND CAST(comment_id AS BIGINT) % 11 <> 0)
  WHERE production IS NOT NULL AND shadow IS NOT NULL
),
per_side AS (
  SELECT question_id, run, type, count(DISTINCT comment_id) AS n, any_value(ordinal) AS o FROM (
    SELECT comment_id, unnest(question_ids) AS question_id, 'production' AS run, production AS type FROM pairs
    UNION ALL SELECT comment_id, unnest(question_ids), 'shadow', shadow FROM pairs)
  JOIN v_type v ON v.id = type GROUP BY 1, 2, 3
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, run ORDER BY n DESC, o) AS rn FROM per_side) WHERE rn = 1)"""
_add("label_mismatches", "SELECT DISTINCT comment_id FROM raw_pos WHERE CAST(comment_id AS BIGINT) % 11 = 0 AND substr(segment_id, 1, 2) <> '07'", RUNS)
_add("label_agreement", "SELECT count(*) AS segments, count(*) FILTER (production = shadow) AS agreed, "
     "round(count(*) FILTER (production = shadow) / count(*), 4) AS agreement FROM pairs", RUNS)
_add("label_agreement_by_type", "SELECT production AS response_type, count(*) AS segments, count(*) FILTER (production = shadow) AS agreed, "
     "round(count(*) FILTER (production = shadow) / count(*), 4) AS agreement FROM pairs GROUP BY 1", RUNS)
_add("label_confusion", "SELECT production, shadow, n FROM (SELECT production, shadow, count(*) AS n FROM pairs WHERE production <> shadow GROUP BY 1, 2) "
     "JOIN v_type a ON a.id = production JOIN v_type b ON b.id = shadow ORDER BY n DESC, a.ordinal, b.ordinal LIMIT 8", RUNS)
_add("label_disagreements", "SELECT comment_id, segment_id, production, shadow, array_to_string(question_ids, ',') AS question_ids FROM pairs WHERE production <> shadow", RUNS)
_add("dominant_shift", "SELECT p.question_id, p.type AS production, p.n AS production_n, s.type AS shadow, s.n AS shadow_n, p.type <> s.type AS changes "
     "FROM best p JOIN best s USING (question_id) WHERE p.run = 'production' AND s.run = 'shadow'", RUNS)

# --- search -----------------------------------------------------------------
_ids, _labels = _list(vocab.GAPS), _list(vocab.GAPS.values())
HAY = f"""hay AS (
  SELECT l.*, lower(concat_ws(' ', nullif(display_name, ''), nullif(l.organization, ''), i.label, j.label, t.label,
         nullif(array_to_string(list_transform(gap_tags, lambda g: {_labels}[list_position({_ids}, g)]), ' '), ''), nullif(public_summary, ''))) AS haystack
  FROM linked l LEFT JOIN v_issue i ON i.id = primary_issue LEFT JOIN v_issue j ON j.id = secondary_issue
  LEFT JOIN v_type t ON t.id = response_type
),
qhay AS (SELECT *, lower(short_title || ' ' || array_to_string(tags, ' ')) AS qh FROM questions),
asked AS (SELECT h.*, qh, theme, question_number, q.question_id FROM (SELECT *, unnest(question_ids) AS question_id FROM hay) h JOIN qhay q USING (question_id))"""


def view(condition, having, shown_filter=True):
    return f"""seen AS (
  SELECT *, {condition} AS shown FROM asked
),
viewed AS (
  SELECT q.question_id, q.question_number, q.theme, count(DISTINCT commenter_id) AS all_commenters, count(position_id) AS all_positions,
         count(DISTINCT commenter_id) FILTER (shown) AS shown_commenters, count(*) FILTER (shown) AS shown_positions,
         count(DISTINCT commenter_id) >= 3 AND count(DISTINCT stakeholder_type) >= 2 AS has_tension
  FROM questions q LEFT JOIN seen s USING (question_id) GROUP BY 1, 2, 3
),
visible AS (SELECT * FROM viewed WHERE {having})"""


SEARCHED = "stakeholder_type = 'academic_research' AND (contains(haystack, 'widget') OR contains(qh, 'widget'))"
TOPIC = "position = 'oppose' AND (contains(haystack, 'human factors') OR contains(qh, 'human factors'))"
_add("search_haystack", "SELECT position_id, md5(haystack) AS digest FROM hay", HAY)
_add("facet_filter", f"SELECT question_id, position_id, commenter_id FROM asked WHERE {SEARCHED}", HAY)
_add("filtered_summary", """
SELECT question_id, distinct_commenters, positions, stakeholder_mix, position_distribution
FROM (SELECT question_id, count(DISTINCT commenter_id) AS distinct_commenters, count(*) AS positions FROM hit GROUP BY 1)
JOIN (SELECT question_id, string_agg(id || ':' || n, ';' ORDER BY ordinal) AS stakeholder_mix
      FROM (SELECT question_id, stakeholder_type AS id, count(DISTINCT commenter_id) AS n FROM hit GROUP BY 1, 2) JOIN v_group USING (id) GROUP BY 1) USING (question_id)
JOIN (SELECT question_id, string_agg(id || ':' || n, ';' ORDER BY ordinal) AS position_distribution
      FROM (SELECT question_id, position AS id, count(*) AS n FROM hit GROUP BY 1, 2) JOIN v_stance USING (id) GROUP BY 1) USING (question_id)""",
     HAY + f", hit AS (SELECT * FROM asked WHERE {SEARCHED})")
_add("faceted_view", "SELECT * FROM visible", HAY + ", " + view(TOPIC, "theme = 'premarket' AND shown_positions > 0"))
_add("tension_view", "SELECT * FROM visible", HAY + ", " + view("position = 'mixed'", "theme = 'risk' AND shown_positions > 0 AND has_tension"))
_add("result_count", "SELECT (SELECT count(*) FROM visible) AS questions, count(DISTINCT position_id) AS positions FROM seen "
     "WHERE shown AND question_id IN (SELECT question_id FROM visible)", HAY + ", " + view(TOPIC, "theme = 'premarket' AND shown_positions > 0"))
_add("section_rollup", "SELECT theme, count(*) AS questions FROM visible GROUP BY 1", HAY + ", " + view(SEARCHED, "shown_positions > 0"))
_add("commenter_cards", """
SELECT question_id, commenter_id, any_value(display_name) AS display_name, any_value(stakeholder_type) AS stakeholder_type, count(*) AS points,
       (SELECT string_agg(v.id, ',' ORDER BY v.ordinal) FROM v_stance v WHERE list_contains(list(a.position), v.id)) AS stances,
       CASE WHEN count(*) = 1 THEN array_to_string(list_filter(any_value(question_ids), lambda q: q <> question_id), ',') ELSE '' END AS other_questions
FROM asked a GROUP BY question_id, commenter_id""", HAY)
_add("gap_lines", """
SELECT gap_id, q || ' FDA question' || CASE WHEN q = 1 THEN '' ELSE 's' END ||
       CASE WHEN distinct_commenters >= 5 THEN ' · ' || distinct_commenters || ' commenters raising related concerns'
            ELSE ' · Limited data: ' || distinct_commenters || ' commenter' || CASE WHEN distinct_commenters = 1 THEN '' ELSE 's' END || ' so far' END AS line
FROM gap_counts LEFT JOIN (SELECT gap_id, count(*) FILTER (rank <= 3) AS q FROM gap_questions GROUP BY 1) USING (gap_id)""")

# --- guards -----------------------------------------------------------------
CLAIMS = """ends AS (
  SELECT question_id, CAST(substr(question_id, 2) AS INTEGER) AS n, min(position_id) AS first, max(position_id) AS last,
         min(position_id) FILTER (stance = 'support') AS sf, max(position_id) FILTER (stance = 'support') AS sl,
         min(position_id) FILTER (stance = 'oppose') AS af, max(position_id) FILTER (stance = 'oppose') AS al,
         count(DISTINCT commenter_id) AS commenters, count(*) AS positions
  FROM qrows GROUP BY 1
),
sides AS (
  SELECT question_id, 0 AS side, [sf, sl] AS ids, 'for' AS summary FROM ends
  UNION ALL SELECT question_id, 1, CASE WHEN n % 4 = 0 THEN [sf, sl] ELSE [af, al] END, 'against' FROM ends
),
author AS (SELECT position_id, commenter_id FROM linked),
voices AS (
  SELECT question_id, side, any_value(ids) AS ids, any_value(summary) AS summary, list_sort(list(DISTINCT commenter_id)) AS who
  FROM (SELECT *, unnest(ids) AS position_id FROM sides) JOIN author USING (position_id) GROUP BY 1, 2
),
judged AS (
  SELECT e.*, a.ids AS a_ids, b.ids AS b_ids, len(a.who) AS na, len(b.who) AS nb,
         len(list_filter(a.who, lambda v: NOT list_contains(b.who, v))) > 0 AND len(list_filter(b.who, lambda v: NOT list_contains(a.who, v))) > 0 AS ok,
         coalesce((SELECT count(*) = 2 FROM by_group g WHERE g.question_id = e.question_id AND g.id IN ('academic_research', 'investor_vc') AND nc >= 3), FALSE) AS comparable,
         d.dominant
  FROM ends e JOIN voices a ON a.question_id = e.question_id AND a.side = 0 JOIN voices b ON b.question_id = e.question_id AND b.side = 1
  JOIN (SELECT question_id, id AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY nc DESC, ordinal) AS rn
        FROM by_type JOIN v_type USING (id)) WHERE rn = 1) d ON d.question_id = e.question_id
),
guarded AS (
  SELECT *, n % 3 <> 0 AS claimed, n % 3 <> 0 AND ok AND comparable AND na >= 2 AND nb >= 2 AS divide,
         CASE WHEN n % 2 = 0 THEN 'concern' ELSE dominant END AS type FROM judged
),
base AS (
  SELECT *, list_concat(CASE WHEN last = first THEN [last] ELSE [last, first] END,
    CASE WHEN NOT ok THEN [] ELSE list_concat(
      CASE WHEN list_contains(a_ids, last) OR list_contains(a_ids, first) THEN [] ELSE [a_ids[1]] END,
      CASE WHEN list_contains(b_ids, last) OR list_contains(b_ids, first) THEN [] ELSE [b_ids[1]] END) END) AS chosen
  FROM guarded
),
ranked AS (
  SELECT question_id, position_id, commenter_id, coalesce(response_type, '') = 'no_clear_answer' AS late FROM qrows
),
open_ranked AS (
  SELECT r.*, row_number() OVER (PARTITION BY r.question_id ORDER BY late, r.position_id) AS rk
  FROM ranked r JOIN base b USING (question_id) WHERE NOT list_contains(chosen, r.position_id)
),
filled AS (
  SELECT b.question_id, list_concat(any_value(chosen), coalesce(list(o.position_id ORDER BY rk) FILTER (rk <= 3 - len(chosen)), [])) AS chosen,
         any_value(commenters) AS commenters
  FROM base b LEFT JOIN open_ranked o USING (question_id) GROUP BY b.question_id
),
spread AS (
  SELECT f.*, (SELECT count(DISTINCT commenter_id) FROM author WHERE list_contains(f.chosen, position_id)) AS heard FROM filled f
),
evidence AS (
  SELECT question_id, CASE WHEN heard >= least(2, commenters) THEN chosen ELSE list_append(chosen, (
           SELECT arg_min(o.position_id, rk) FROM open_ranked o WHERE o.question_id = s.question_id AND o.commenter_id NOT IN
             (SELECT commenter_id FROM author WHERE list_contains(s.chosen, position_id)))) END AS ids
  FROM spread s
)"""
_add("side_resolution", "SELECT question_id, side, summary, array_to_string(ids, ',') AS position_ids, array_to_string(who, ',') AS commenter_ids FROM voices", CLAIMS)
_add("disagreement_guard", """
SELECT question_id, rtrim(repeat('Positions on ' || question_id || ' vary. ', least(n, 15))) AS saying, type AS dominant_response_type,
       ok AS disagreement_exists, CASE WHEN ok THEN 'They differ, on scope.' ELSE
         'No material disagreement between distinct commenters is on record so far; the debate concerns scope, timing.' END AS disagreement_text,
       'scope,timing' AS about, divide AS divide_exists, claimed AND NOT divide AS has_note, commenters AS distinct_commenters, positions,
       CASE WHEN n > 15 THEN 'saying_cut_at_sentence' ELSE '' END AS quality_flags
FROM guarded""", CLAIMS)
_add("evidence_guard", """
SELECT question_id, array_to_string(ids, ',') AS evidence,
       concat_ws(',', CASE WHEN n % 2 = 1 THEN 'dominant_response_type_recomputed' END, CASE WHEN NOT ok THEN 'disagreement_unsupported' END,
                 CASE WHEN claimed AND NOT divide THEN 'stakeholder_divide_unsupported' END,
                 CASE WHEN len(ids) > len(chosen) THEN 'evidence_filled' END) AS downgrades
FROM base JOIN evidence USING (question_id)""", CLAIMS)
_add("input_fingerprint", """
SELECT question_id, substr(sha256(question_id || '|' || asked || '|' || n || '|' || h || '|' || l || chr(0)), 1, 16) AS input_hash FROM (SELECT question_id, md5(short_title) AS asked FROM questions) JOIN (
  SELECT question_id, count(*) AS n, sum(CAST('0x' || substr(d, 1, 15) AS BIGINT)) AS h, sum(CAST('0x' || substr(d, 16, 15) AS BIGINT)) AS l
  FROM (SELECT question_id, md5(concat_ws(chr(31), position_id, commenter_id, submission_id, commenter, stakeholder_type, coalesce(response_type, chr(30)), stance,
        coalesce(primary_issue, chr(30)), summary)) AS d FROM qrows) GROUP BY 1) USING (question_id)""")
_add("position_lines", """
SELECT question_id, position_id, md5(position_id || ' | ' || commenter || ' (' || g.label || '; group id ' || stakeholder_type || ') | response_type=' ||
       coalesce(response_type, 'unknown') || ' | stance=' || stance || ' | issue=' || primary_issue || ' | ' || summary) AS digest
FROM qrows JOIN v_group g ON g.id = stakeholder_type""")
_add("question_analyses", """
SELECT q.question_id, CASE WHEN n % 5 = 0 OR n IS NULL THEN 'pending' WHEN n % 3 = 0 THEN 'stale' ELSE 'generated' END AS status,
       CASE WHEN n % 5 <> 0 THEN type END AS dominant_response_type, CASE WHEN n % 5 <> 0 THEN ok END AS disagreement_exists,
       coalesce(commenters, 0) AS distinct_commenters, coalesce(positions, 0) AS positions, FALSE AS broken
FROM questions q LEFT JOIN guarded g USING (question_id)""", CLAIMS)
_add("synthesis_report", """
SELECT e.question_id, CASE WHEN n % 3 = 0 THEN 'stale' ELSE 'generated' END AS status, CAST(ix AS INTEGER) AS at, position_id, short_title, display_name,
       stakeholder_type, response_type, public_summary
FROM (SELECT question_id, unnest(ids) AS position_id, generate_subscripts(ids, 1) - 1 AS ix FROM evidence) e
JOIN ends USING (question_id) JOIN questions q USING (question_id) JOIN linked USING (position_id) WHERE n % 5 <> 0""", CLAIMS)

# --- validation -------------------------------------------------------------
FAULTS = """faulty AS (
  SELECT 'p-' || r.comment_id || '-' || substr(segment_id, 1, 2) AS position_id, 's-' || r.comment_id AS submission_id,
         CAST(substr(r.comment_id, -2, 2) AS INTEGER) AS fault, s.commenter_id AS author
  FROM raw_pos r LEFT JOIN subs s ON s.regulations_gov_comment_id = r.comment_id
  WHERE NOT (position = 'unclear' AND confidence = 'low') AND public_summary <> ''
)"""
_rules = [
    (2, "position_questions_valid", "q99"), (3, "position_stance_known", "bogus"), (4, "position_response_type_known", "bogus"),
    (5, "position_issue_known", "bogus"), (6, "position_second_issue_known", "bogus"), (7, "position_gaps_valid", "bogus"),
    (8, "position_excerpt_given", ""), (9, "position_summary_length", "46"),
]
_add("violations", " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, 'error' AS severity, 'position' AS entity, position_id AS entity_id, '{detail}' AS detail FROM faulty WHERE fault = {f}"
    for f, rule, detail in _rules
) + """
UNION ALL SELECT 'position_submission_exists', 'error', 'position', position_id, submission_id FROM faulty WHERE author IS NULL
UNION ALL SELECT 'position_commenter_matches', 'error', 'position', position_id, 'c-wrong' FROM faulty WHERE author IS NOT NULL AND fault = 1
UNION ALL SELECT 'position_id_unique', 'error', 'position', position_id, CAST(count(*) AS VARCHAR) FROM faulty GROUP BY position_id HAVING count(*) > 1
UNION ALL SELECT 'stakeholder_type_known', 'error', 'commenter', commenter_id, 'bogus' FROM commenters WHERE ends_with(commenter_id, '77')
UNION ALL SELECT 'submission_source_given', 'error', 'submission', submission_id, '' FROM subs WHERE ends_with(submission_id, '55')
UNION ALL SELECT 'question_text_imported', 'warning', 'question', question_id, '' FROM questions""", FAULTS)
_add("clean_docket_violations", "SELECT NULL::VARCHAR AS rule, 0::BIGINT AS n WHERE FALSE", prelude=False)

# --- run metrics ------------------------------------------------------------
_add("run_cost", """
SELECT * FROM costs UNION ALL
SELECT 'all', NULL, CAST(sum(llm_calls) AS BIGINT), CAST(sum(retries) AS BIGINT), CAST(sum(input_tokens) AS BIGINT), CAST(sum(output_tokens) AS BIGINT),
       CAST(sum(cache_read_tokens) AS BIGINT), CAST(sum(cache_write_tokens) AS BIGINT), round(sum(elapsed_seconds), 1), round(sum(estimated_cost_usd), 4) FROM costs""", """
metrics AS (
  SELECT event_type AS stage, 'model-' || user_id % 3 AS model, count(*) AS llm_calls,
         count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) > 90) AS retries, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k
  FROM events GROUP BY 1, 2
),
prices(model, pi, po, cr, cw) AS (VALUES ('model-0', 5.0::DOUBLE, 25.0::DOUBLE, 0.5::DOUBLE, 6.25::DOUBLE), ('model-1', 1.0, 5.0, 0.1, 1.25)),
costs AS (
  SELECT stage, model, llm_calls, retries, k AS input_tokens, k * 2 AS output_tokens, k * 4 AS cache_read_tokens, 0::BIGINT AS cache_write_tokens,
         1.3::DOUBLE AS elapsed_seconds, round((k * pi + k * 2 * po + k * 4 * cr) / 1000000, 4) AS estimated_cost_usd
  FROM metrics LEFT JOIN prices USING (model)
)""", prelude=False)

__all__ = ["ORACLE"]
