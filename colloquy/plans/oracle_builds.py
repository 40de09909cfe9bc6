"""SQL for the queries of ``catalog_builds``."""

from __future__ import annotations

from colloquy.plans import catalog_builds, oracle_more  # noqa: F401  (the queries; the SQL used again)
from colloquy.plans.oracle import ORACLE, _add

_add("answer_violations", """
SELECT k AS o_orderkey, '$' AS path, left('{' || CASE WHEN k % 7 = 0 THEN '' ELSE '"saying":"s",' END || '"dominant_response_type":"' ||
  CASE WHEN k % 5 = 0 THEN 'odd' ELSE 'concern' END || '","disagreement":{"exists":' || CASE WHEN k % 11 = 0 THEN '"yes"' ELSE 'true' END ||
  ',"about":["scope"' || CASE WHEN k % 6 = 0 THEN ',"bogus"' ELSE '' END || '],"text":"t","sides"', 80) AS value, 'not_json' AS rule FROM t WHERE k % 17 = 0
UNION ALL SELECT k, '$.saying', NULL, 'missing' FROM ok WHERE k % 7 = 0
UNION ALL SELECT k, '$.dominant_response_type', 'odd', 'not_listed' FROM ok WHERE k % 5 = 0
UNION ALL SELECT k, '$.disagreement.exists', '"yes"', 'wrong_type' FROM ok WHERE k % 11 = 0
UNION ALL SELECT k, '$.disagreement.about[1]', 'bogus', 'not_listed' FROM ok WHERE k % 6 = 0
UNION ALL SELECT k, '$.disagreement.sides[1].summary', '5', 'wrong_type' FROM ok WHERE k % 13 = 0
UNION ALL SELECT k, '$.disagreement.sides[1].position_ids[0]', NULL, 'null' FROM ok WHERE k % 4 = 0
UNION ALL SELECT k, '$.disagreement.sides[1].more', '{"x":1}', 'not_declared' FROM ok WHERE k % 9 = 0
""", "t AS (SELECT o_orderkey AS k FROM orders), ok AS (SELECT k FROM t WHERE k % 17 <> 0)", prelude=False)
_add("salted_authors", "SELECT o_orderkey AS submission_id, author, c_mktsegment AS kind FROM "
     "(SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 7 THEN 1 ELSE o_custkey END AS author FROM orders) JOIN customer ON c_custkey = author", prelude=False)
_add("landed_build", """
SELECT 'quarantine' AS kind, 'comments: not a whole document' AS key, count(*) AS n FROM c WHERE k % 97 = 0 HAVING count(*) > 0
UNION ALL SELECT 'quarantine', 'meta: not a whole document', count(*) FROM c WHERE k % 83 = 0 HAVING count(*) > 0
UNION ALL SELECT 'quarantine', 'commenters: document without an id', count(*) FROM c WHERE k % 31 <> 0 AND k % 79 = 0 HAVING count(*) > 0
UNION ALL SELECT 'quarantine', 'analysis: not a whole document', count(*) FROM a WHERE k % 89 = 0 HAVING count(*) > 0
UNION ALL SELECT 'excluded', reason, count(*) FROM r WHERE reason IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'without_types', 'all', count(*) FROM a WHERE k % 89 <> 0 AND k % 5 = 0
UNION ALL SELECT 'position', coalesce(CASE WHEN k % 5 <> 0 THEN response_type END, 'none'), count(*) FROM raw_pos p JOIN r USING (comment_id) WHERE reason IS NULL GROUP BY 1, 2
""", """c AS (SELECT *, CAST(comment_id AS BIGINT) AS k FROM cand),
a AS (SELECT c.comment_id, k FROM c WHERE analyzed AND comment_id IN (SELECT comment_id FROM raw_pos)),
r AS (SELECT c.comment_id, k, CASE WHEN withdrawn THEN 'withdrawn' WHEN k % 83 = 0 OR NOT usable THEN 'no_usable_text'
        WHEN k % 31 = 0 OR k % 79 = 0 OR a.comment_id IS NULL OR k % 89 = 0 THEN 'not_yet_classified' END AS reason
      FROM c LEFT JOIN (SELECT comment_id FROM a) a USING (comment_id) WHERE k % 97 <> 0)""")
ORACLE["published_changes"] = ORACLE["change_queue"]
_add("version_store", "SELECT coalesce(b.user_id, a.user_id) AS comment_id, CASE WHEN b.ts > a.ts OR a.ts IS NULL THEN b.event_id ELSE a.event_id END AS event_id, "
     "CASE WHEN b.ts > a.ts OR a.ts IS NULL THEN b.event_type ELSE a.event_type END AS event_type FROM a FULL JOIN b ON a.user_id = b.user_id",
     """ranked AS (SELECT *, event_id % 3 = 0 AS early, row_number() OVER (PARTITION BY user_id, event_id % 3 = 0 ORDER BY ts DESC, event_id DESC) AS rn FROM events),
a AS (SELECT user_id, ts, event_id, event_type FROM ranked WHERE rn = 1 AND early), b AS (SELECT user_id, ts, event_id, event_type FROM ranked WHERE rn = 1 AND NOT early)""",
     prelude=False)
_add("bucket_store", "SELECT CAST(o_orderkey AS VARCHAR) AS comment_id, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS status "
     "FROM orders WHERE o_orderkey % 5 <> 0", prelude=False)
_add("faulty_analyses", "SELECT 'analysis_per_question' AS rule, 'error' AS severity, 'analysis' AS entity, 'q6' AS entity_id "
     "UNION ALL SELECT 'analysis_unique', 'error', 'analysis', question_id FROM qrows WHERE question_id = 'q9' GROUP BY 4 "
     "UNION ALL SELECT 'analysis_question_known', 'error', 'analysis', 'q27' FROM qrows WHERE question_id = 'q3' GROUP BY 4 "
     "UNION ALL SELECT 'curated_gaps_complete', 'error', 'gaps', 'all' FROM v_gap GROUP BY 4 HAVING count(*) = 9")
