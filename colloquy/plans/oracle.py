"""ANSI-style SQL for the registered queries, for a side-by-side check.

``PRELUDE`` restates the table mapping of ``colloquy.sources.driver_tables``
and the assembly rules as common table expressions; each entry adds a SELECT.
"""

from __future__ import annotations

from colloquy import vocab
from colloquy.sources import driver_tables as src


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _case(column: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {whens} END"


def _values(name: str, ids, columns: str = "ordinal, id, label") -> str:
    items = ids.items() if isinstance(ids, dict) else [(v, v) for v in ids]
    rows = ", ".join(
        "({}, '{}', '{}')".format(i, k, (v if isinstance(v, str) else v[0]).replace("'", "''"))
        for i, (k, v) in enumerate(items, start=1)
    )
    return f"{name}({columns}) AS (VALUES {rows})"


SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
THEME = (
    "CASE WHEN n <= 6 THEN 'risk' WHEN n <= 17 THEN 'premarket' WHEN n <= 24 THEN 'postmarket' "
    "ELSE 'foundation_models_agents' END"
)
_issues = _list(vocab.ISSUES)
_issue_labels = _list(vocab.ISSUES.values())
_gaps = _list(vocab.GAPS)

PRELUDE = f"""
WITH {_values("v_group", vocab.STAKEHOLDER_TYPES)},
{_values("v_stance", vocab.STANCES)},
{_values("v_issue", vocab.ISSUES)},
{_values("v_gap", vocab.GAPS)},
{_values("v_type", {**vocab.RESPONSE_TYPES, "unknown": "unknown"})},
{_values("v_theme", {t.id: t.label for t in vocab.THEMES})},
questions AS (
  SELECT 'q' || n AS question_id, CAST(n AS INTEGER) AS question_number, {THEME} AS theme,
         'Topic ' || n || ': ' || {_issue_labels}[((n - 1) % 21) + 1] AS short_title,
         [{THEME}, lower({_issue_labels}[((n - 1) % 21) + 1])] AS tags
  FROM range(1, 27) AS r(n)
),
cand AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS comment_id,
         (o_orderstatus = 'P' AND o_orderkey % 7 = 0) AS withdrawn,
         o_totalprice >= 10000 AS usable,
         NOT (o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 3 = 0) AS analyzed,
         c_custkey IS NOT NULL AS identified,
         CASE WHEN o_custkey % 5 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS organization,
         coalesce({_list(vocab.STAKEHOLDER_TYPES)}[
           (list_position({_list(src.SEGMENTS)}, c_mktsegment) - 1) * 2 + c_nationkey % 2 + 1], 'other') AS stakeholder_type,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS received_date,
         CAST(CAST(o_orderdate AS DATE) + 2 AS VARCHAR) AS posted_date,
         'https://example.org/comment/' || o_orderkey AS source_url,
         o_orderkey % 4 = 0 AS has_attachments
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
),
reasoned AS (
  SELECT *, CASE WHEN withdrawn THEN 'withdrawn' WHEN NOT usable THEN 'no_usable_text'
                 WHEN NOT (identified AND analyzed) THEN 'not_yet_classified' END AS reason_code
  FROM cand
),
accepted AS (
  SELECT *, CASE WHEN trim(organization) <> '' AND stakeholder_type <> 'individual'
                 THEN 'c-' || {SLUG.format("trim(organization)")}
                 ELSE 'c-' || lower(comment_id) END AS commenter_id
  FROM reasoned WHERE reason_code IS NULL
),
commenters AS (
  SELECT commenter_id, coalesce(nullif(trim(organization), ''), 'Individual commenter') AS display_name,
         trim(organization) AS organization, stakeholder_type
  FROM (SELECT *, row_number() OVER (PARTITION BY commenter_id ORDER BY comment_id) AS rn FROM accepted)
  WHERE rn = 1
),
subs AS (
  SELECT 's-' || lower(comment_id) AS submission_id, comment_id AS regulations_gov_comment_id, commenter_id,
         received_date, posted_date, source_url, has_attachments
  FROM accepted
),
raw_pos AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS comment_id,
         lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || l_partkey || '-' || l_suppkey || '-' ||
           CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS segment_id,
         CASE WHEN l_partkey % 26 = l_suppkey % 26 THEN ['q' || (l_partkey % 26 + 1)]
              ELSE ['q' || least(l_partkey % 26 + 1, l_suppkey % 26 + 1), 'q' || greatest(l_partkey % 26 + 1, l_suppkey % 26 + 1)]
         END AS question_ids,
         {_case("l_returnflag || l_linestatus", src.STANCE_OF_FLAGS)} AS position,
         {_list(vocab.CONFIDENCE)}[CAST(l_quantity AS INTEGER) % 3 + 1] AS confidence,
         {_issues}[CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 21 + 1] AS primary_issue,
         CASE WHEN CAST(l_quantity AS INTEGER) % 5 = 0 THEN NULL
              ELSE {_issues}[(CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) + 3) % 21 + 1] END AS secondary_issue,
         CASE WHEN p_size % 10 = 0 THEN NULL ELSE {_case("p_type", src.RESPONSE_OF_PART)} END AS response_type,
         'worry about ' || p_name AS stakeholder_concern,
         'act on ' || p_name AS requested_fda_action,
         list_slice([{_gaps}[l_suppkey % 9 + 1], {_gaps}[(l_suppkey + 2) % 9 + 1], {_gaps}[(l_suppkey + 5) % 9 + 1]],
                    1, CAST(l_quantity AS INTEGER) % 4) AS gap_tags,
         CASE WHEN CAST(l_quantity AS INTEGER) = 50 THEN ''
              ELSE 'Asks for a ' || p_name || ' rule of size ' || p_size || '.' END AS public_summary,
         'We ask the agency for a ' || p_name || ' rule, item ' || l_linenumber || '.' AS source_passage
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
),
positions AS (
  SELECT 'p-' || lower(comment_id) || '-' || segment_id AS position_id, 's-' || lower(comment_id) AS submission_id,
         * EXCLUDE (comment_id, segment_id),
         coalesce(confidence = 'high' AND length(source_passage) BETWEEN 40 AND 420, FALSE) AS featured
  FROM raw_pos
  WHERE NOT coalesce(position = 'unclear' AND confidence = 'low', FALSE) AND coalesce(public_summary, '') <> ''
),
linked AS (
  SELECT p.*, s.commenter_id, c.display_name, c.organization, c.stakeholder_type
  FROM positions p JOIN subs s USING (submission_id) JOIN commenters c USING (commenter_id)
),
qrows AS (
  SELECT unnest(question_ids) AS question_id, position_id, commenter_id, display_name AS commenter, stakeholder_type,
         submission_id, response_type, position AS stance, primary_issue, public_summary AS summary
  FROM linked
),
by_type AS (
  SELECT question_id, coalesce(response_type, 'unknown') AS id, count(DISTINCT commenter_id) AS nc, count(*) AS np
  FROM qrows GROUP BY ALL
),
by_group AS (
  SELECT question_id, stakeholder_type AS id, count(DISTINCT commenter_id) AS nc FROM qrows GROUP BY ALL
),
by_stance AS (SELECT question_id, stance AS id, count(*) AS np FROM qrows GROUP BY ALL),
basics AS (
  SELECT q.question_id, q.question_number, q.theme, count(DISTINCT commenter_id) AS distinct_commenters,
         count(DISTINCT submission_id) AS distinct_submissions, count(position_id) AS positions,
         count(DISTINCT stakeholder_type) AS n_groups
  FROM questions q LEFT JOIN qrows r USING (question_id) GROUP BY ALL
),
mixes AS (
  SELECT question_id, string_agg(id || ':' || nc, ';' ORDER BY ordinal) AS stakeholder_mix
  FROM by_group JOIN v_group USING (id) GROUP BY question_id
),
stances AS (
  SELECT question_id, string_agg(id || ':' || np, ';' ORDER BY ordinal) AS position_distribution
  FROM by_stance JOIN v_stance USING (id) GROUP BY question_id
),
types AS (
  SELECT question_id, string_agg(id || ':' || nc, ';' ORDER BY ordinal) FILTER (id <> 'unknown') AS response_type_commenters,
         string_agg(id || ':' || nc, ';' ORDER BY ordinal) AS by_distinct_commenters,
         string_agg(id || ':' || np, ';' ORDER BY ordinal) AS by_positions
  FROM by_type JOIN v_type USING (id) GROUP BY question_id
),
gap_rows AS (
  SELECT unnest(gap_tags) AS gap_id, * FROM linked
),
gap_counts AS (
  SELECT ordinal, v.id AS gap_id, label AS title, count(DISTINCT commenter_id) AS distinct_commenters, count(position_id) AS positions
  FROM v_gap v LEFT JOIN gap_rows g ON g.gap_id = v.id GROUP BY ALL
),
gap_questions AS (
  SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY positions DESC, question_number) AS rank
  FROM (SELECT gap_id, q AS question_id, CAST(substr(q, 2) AS INTEGER) AS question_number, count(*) AS positions
        FROM (SELECT gap_id, unnest(question_ids) AS q FROM gap_rows) GROUP BY ALL)
)
"""

ORACLE: dict[str, str] = {}


def _add(name: str, select: str, ctes: str = "", prelude: bool = True) -> None:
    if prelude:
        ORACLE[name] = f"{PRELUDE}{', ' + ctes if ctes else ''}\n{select}"
    else:
        ORACLE[name] = f"{'WITH ' + ctes if ctes else ''}\n{select}"


# --- assembly ---------------------------------------------------------------
_add("exclusions", "SELECT reason_code AS reason, count(*) AS n FROM reasoned WHERE reason_code IS NOT NULL GROUP BY 1 "
     "UNION ALL SELECT 'unclear_low_confidence_positions', count(*) FROM raw_pos WHERE position = 'unclear' AND confidence = 'low' "
     "UNION ALL SELECT 'positions_without_summary', count(*) FROM raw_pos "
     "WHERE NOT (position = 'unclear' AND confidence = 'low') AND public_summary = '' HAVING count(*) > 0")
_add("excluded_comments", "SELECT comment_id, CASE reason_code WHEN 'withdrawn' THEN 'withdrawn' WHEN 'no_usable_text' THEN "
     "'no usable text' ELSE 'classification pending' END AS reason FROM reasoned WHERE reason_code IS NOT NULL")
_add("commenter_resolution", "SELECT * FROM commenters")
_add("public_submissions", "SELECT * FROM subs")
_add("public_positions", "SELECT position_id, submission_id, commenter_id, array_to_string(question_ids, ',') AS question_ids, "
     "position, nullif(response_type, '') AS response_type, primary_issue, nullif(secondary_issue, '') AS secondary_issue, "
     "stakeholder_concern, requested_fda_action, public_summary, source_passage AS supporting_text, "
     "array_to_string(gap_tags, ',') AS gap_tags, featured FROM linked")
_add("public_commenters", "SELECT * FROM commenters")
_add("submissions_without_positions", "SELECT s.submission_id, s.regulations_gov_comment_id FROM subs s "
     "WHERE NOT EXISTS (SELECT 1 FROM positions p WHERE p.submission_id = s.submission_id)")
_add("featured_positions", "SELECT position_id, length(source_passage) AS passage_chars FROM positions WHERE featured")
_add("positions_by_question", "SELECT question_id, position_id, commenter_id, commenter, stakeholder_type, submission_id, "
     "response_type, stance, primary_issue, summary FROM qrows")
_add("theme_lookup", "SELECT question_id, theme, label, q.question_number FROM questions q JOIN v_theme ON id = theme WHERE question_id IN (SELECT question_id FROM qrows)")
_add("evidence_lookup", "SELECT position_id, commenter_id, display_name, stakeholder_type, "
     "received_date, regulations_gov_comment_id, source_url, source_passage AS supporting_text "
     "FROM linked JOIN subs USING (submission_id, commenter_id) "
     "WHERE position_id IN (SELECT min(position_id) FROM qrows GROUP BY question_id)")

# --- statistics -------------------------------------------------------------
_add("question_stats", "SELECT b.question_id, question_number, theme, distinct_commenters, distinct_submissions, positions, "
     "coalesce(stakeholder_mix, '') AS stakeholder_mix, coalesce(position_distribution, '') AS position_distribution, "
     "coalesce(response_type_commenters, '') AS response_type_commenters, "
     "distinct_commenters >= 3 AND n_groups >= 2 AS tension_eligible, distinct_commenters >= 5 AS conclusion_eligible "
     "FROM basics b LEFT JOIN mixes USING (question_id) LEFT JOIN stances USING (question_id) LEFT JOIN types USING (question_id)")
_add("stakeholder_mix", "SELECT question_id, id AS stakeholder_type, nc AS commenters FROM by_group")
_add("stance_distribution", "SELECT question_id, id AS stance, np AS positions FROM by_stance")
_add("response_type_commenters", "SELECT question_id, id AS response_type, nc AS commenters FROM by_type WHERE id <> 'unknown'")
_add("eligibility", "SELECT question_id, distinct_commenters >= 3 AND n_groups >= 2 AS tension_eligible, "
     "distinct_commenters >= 5 AS conclusion_eligible FROM basics")
_add("response_type_distribution", "SELECT question_id, by_distinct_commenters, by_positions FROM types")
_add("comparable_groups", "SELECT question_id, coalesce(string_agg(id, ',' ORDER BY id) FILTER (nc >= 3), '') AS comparable_groups "
     "FROM by_group GROUP BY 1")
_add("dominant_type", "SELECT question_id, id AS dominant_response_type FROM (SELECT *, row_number() OVER "
     "(PARTITION BY question_id ORDER BY nc DESC, ordinal) AS rn FROM by_type JOIN v_type USING (id)) WHERE rn = 1")
_add("gap_stats", "SELECT c.ordinal, c.gap_id, title, distinct_commenters, positions, coalesce(t, '') AS stakeholder_types, "
     "coalesce(qs, '') AS question_ids FROM gap_counts c "
     "LEFT JOIN (SELECT gap_id, string_agg(stakeholder_type, ',' ORDER BY n DESC, o) AS t FROM (SELECT gap_id, stakeholder_type, "
     "any_value(v.ordinal) AS o, count(DISTINCT commenter_id) AS n FROM gap_rows JOIN v_group v ON v.id = stakeholder_type GROUP BY 1, 2) GROUP BY 1) USING (gap_id) "
     "LEFT JOIN (SELECT gap_id, string_agg(question_id, ',' ORDER BY rank) AS qs FROM gap_questions WHERE rank <= 3 GROUP BY 1) USING (gap_id)")
_add("gap_top_questions", "SELECT gap_id, CAST(rank AS INTEGER) AS rank, question_id, positions FROM gap_questions WHERE rank <= 3")
_add("gap_examples", "SELECT gap_id, CAST(rk AS INTEGER) AS rank, position_id, commenter_id, display_name, question_id, excerpt FROM ("
     "SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY NOT featured, position_id) AS rk FROM ("
     "SELECT gap_id, commenter_id, display_name, featured, position_id, question_ids[1] AS question_id, source_passage AS excerpt, "
     "row_number() OVER (PARTITION BY gap_id, commenter_id ORDER BY NOT featured, position_id) AS rc FROM gap_rows "
     "WHERE coalesce(source_passage, '') <> '') WHERE rc = 1) WHERE rk <= 3")
_add("docket_metrics", "SELECT (SELECT count(*) FROM subs) AS comments_analyzed, count(DISTINCT commenter_id) AS commenters_represented, "
     "count(*) AS positions_identified, 26::BIGINT AS questions_tracked FROM linked")
_add("stance_totals", "SELECT position AS stance, count(*) AS n FROM linked GROUP BY 1")
PATTERN = (
    "led AS (SELECT question_id, coalesce(sum(np) FILTER (id = 'support_with_modification'), 0) AS m, "
    "coalesce(max(np) FILTER (id <> 'support_with_modification'), 0) AS o FROM by_stance GROUP BY 1), "
    "tot AS (SELECT count(*) AS positions, count(*) FILTER (position = 'support_with_modification') AS modify, "
    "count(*) FILTER (position = 'oppose') AS oppose FROM linked), "
    "elig AS (SELECT count(*) FILTER (distinct_commenters >= 5) AS eligible_questions, "
    "count(*) FILTER (distinct_commenters >= 5 AND m <= o) AS not_led, count(*) AS questions "
    "FROM basics LEFT JOIN led USING (question_id)), "
    "pattern AS (SELECT eligible_questions > 0 AND positions > 0 AND not_led = 0 AND modify * 2 > positions AND oppose * 10 < positions AS holds, "
    "modify, oppose, positions, eligible_questions, questions FROM elig, tot), "
    "top AS (SELECT * FROM basics JOIN (SELECT question_id, short_title FROM questions) USING (question_id) "
    "ORDER BY distinct_commenters DESC, positions DESC, question_number LIMIT 1)"
)
_add("docket_pattern", "SELECT * FROM pattern", PATTERN)
_add("most_discussed", "SELECT question_id, short_title, distinct_commenters, positions FROM top", PATTERN)
_add("theme_rollup", "SELECT theme, CAST(sum(positions) AS BIGINT) AS positions, count(*) AS questions FROM basics GROUP BY 1")
_add("blind_spot", "SELECT gap_id, distinct_commenters FROM gap_counts WHERE distinct_commenters > 0 "
     "ORDER BY distinct_commenters DESC, ordinal LIMIT 1")
_add("signal_cards", """
SELECT category, headline, evidence, target_question_id FROM (
  SELECT *, row_number() OVER (ORDER BY claim) AS rn FROM (
    SELECT 0 AS claim, 'most_discussed' AS category, short_title AS headline,
           'Q' || question_number || ' · ' || distinct_commenters || ' commenters · ' || positions || ' positions' AS evidence,
           question_id AS target_question_id FROM top WHERE distinct_commenters > 0
    UNION ALL
    SELECT 1, 'pattern', 'The debate is about how, not whether', modify || ' of ' || p.positions || ' positions ask for modification · ' ||
           oppose || ' oppose · plurality on ' || eligible_questions || ' of ' || questions || ' questions', question_id
    FROM pattern p, top WHERE holds
    UNION ALL
    SELECT 900, 'blind_spot', title, CASE WHEN distinct_commenters >= 5 THEN distinct_commenters || ' commenters · ' ELSE 'Limited data · ' END ||
           (SELECT string_agg('Q' || question_number, ', ' ORDER BY rank) FROM gap_questions q WHERE q.gap_id = g.gap_id AND rank <= 3),
           (SELECT question_id FROM gap_questions q WHERE q.gap_id = g.gap_id AND rank = 1)
    FROM (SELECT * FROM gap_counts WHERE distinct_commenters > 0 ORDER BY distinct_commenters DESC, ordinal LIMIT 1) g
    UNION ALL
    SELECT 1001, 'pattern', 'Not enough comments yet', 'Limited data', question_id FROM top WHERE NOT (SELECT holds FROM pattern)
  )) WHERE rn <= 3""", PATTERN)
