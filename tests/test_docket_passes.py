"""Rows that several steps read are joined once, and few ids shuffle no positions."""
import pytest

from colloquy.operators import assemble, guards, stats, validate
from colloquy.plans import catalog_more
from colloquy.plans.docket import Docket
from colloquy.session import cut_lineage, stored
from conftest import SMALL


@pytest.fixture(scope="module")
def docket(spark):
    return Docket.from_driver_tables(spark, SMALL)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_citations_shuffle_no_positions(docket):
    rows = catalog_more.guarded_rows(docket)
    found = guards.cited_ids(cut_lineage(catalog_more.claims_of(rows)), rows)
    assert "SortMergeJoin" not in plan(found) and "Exchange hashpartitioning" not in plan(found) and found.count()


def test_analyses_are_made_from_rows_that_lie_written(docket):
    made = catalog_more._published(docket)
    assert "lineitem" not in plan(made) and made.count() == 26


def test_a_rollup_at_hand_gives_the_same_guards(docket):
    rows = catalog_more.guarded_rows(docket)
    claims = cut_lineage(catalog_more.claims_of(rows))
    plain = guards.guard(claims, docket.question_rows)
    shared = guards.guard(claims, rows, stored(stats.commenter_rollup(rows), "rollup"), written=True)
    assert sorted(map(str, plain.collect())) == sorted(map(str, shared.collect())) and plain.count() == 26


def test_rules_on_analyses_look_positions_up_once(docket):
    analyses = cut_lineage(catalog_more._published(docket))
    found = validate.analysis_rules(analyses, assemble.public_positions(docket.linked), docket.questions)
    assert "lineitem" not in plan(found)
    lost = analyses.filter("question_id = 'q8'").selectExpr("* EXCEPT (evidence_position_ids)", "array('p-gone') AS evidence_position_ids")
    told = validate.analysis_rules(lost, assemble.public_positions(docket.linked), docket.questions.filter("question_id = 'q8'"))
    assert {(r.rule, r.entity_id) for r in told.collect()} >= {("evidence_exists", "q8")}


def test_report_leaves_positions_nobody_cites_before_any_join(docket):
    analyses = cut_lineage(catalog_more._published(docket))
    rows = guards.report(docket.questions, analyses, docket.linked)
    text = plan(rows)
    assert "LeftSemi" in text and rows.filter("display_name IS NULL").isEmpty() and rows.count()


def test_snapshots_of_two_dates_share_their_rows(docket):
    dated = catalog_more.dated_rows(docket)
    for before in (None, catalog_more.EARLY):
        shared = catalog_more._build(docket, before, dated)
        assert "lineitem" not in plan(shared)
        assert sorted(map(str, shared.collect())) == sorted(map(str, catalog_more._build(docket, before).collect()))
