"""Hand-made scenarios for the relational operators."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy import vocab
from colloquy.operators import assemble, changes, compare, facets, freshness, guards, labels, segments, stats, validate
from colloquy.plans.docket import gap_dimension

ROW = (
    "question_id string, position_id string, commenter_id string, commenter string, stakeholder_type string, "
    "submission_id string, response_type string, stance string, primary_issue string, summary string"
)


def row(pid, who, kind="implementation_issue", group="academic_research", issue="human_factors", q="q14", stance="mixed"):
    return (q, pid, who, f"Team {who}", group, f"s-{who}", kind, stance, issue, f"{who} on {issue} in {pid}")


def rows_of(spark, rows):
    return spark.createDataFrame(rows, ROW)


def questions_of(spark):
    return vocab.questions_frame(spark).withColumns({
        "short_title": F.concat(F.lit("Title "), "question_id"), "tags": F.array(F.lit("tag")), "has_tension_block": F.lit(True),
    })


def test_an_author_counts_once_whatever_they_send(spark):
    """Two submissions with four positions by one author, one by another."""
    rows = [row(f"w{i}", "ada", q="q11") for i in range(4)] + [row("w9", "bo", group="investor_vc", q="q11")]
    rows[3] = (*rows[3][:5], "s-ada-again", *rows[3][6:])
    got = {r.question_id: r for r in stats.question_stats(rows_of(spark, rows), questions_of(spark)).collect()}
    one = got["q11"]
    assert (one.distinct_commenters, one.distinct_submissions, one.positions) == (2, 3, 5)
    assert one.stakeholder_mix == {"academic_research": 1, "investor_vc": 1} and not one.conclusion_eligible and not one.tension_eligible
    assert len(got) == 26 and got["q25"].positions == 0 and got["q25"].position_distribution == {}


LINKED = (
    "position_id string, submission_id string, commenter_id string, display_name string, stakeholder_type string, "
    "question_ids array<string>, position string, gap_tags array<string>, featured boolean, supporting_text string"
)


def test_few_voices_give_three_cautious_cards(spark):
    linked = spark.createDataFrame([
        ("w31", "s-ada", "ada", "Ada Labs", "academic_research", ["q20", "q3"], "oppose", ["cybersecurity_as_safety", "operational_harm"], False, "first"),
        ("w32", "s-bo", "bo", "Bo Fund", "investor_vc", ["q20"], "mixed", ["cybersecurity_as_safety"], True, "second"),
        ("w33", "s-cy", "cy", "Cy", "individual", ["q20"], "oppose", [], False, "third"),
    ], LINKED)
    rows = linked.select(F.explode("question_ids").alias("question_id"), "commenter_id", "stakeholder_type", "submission_id",
                         F.lit(None).cast("string").alias("response_type"), F.col("position").alias("stance"))
    per_question, gaps, totals = stats.question_stats(rows, questions_of(spark)), stats.gap_stats(linked, gap_dimension(spark)), stats.stance_totals(linked)
    cards = stats.signal_cards(questions_of(spark), per_question, gaps, totals).collect()
    assert [c.category for c in cards] == ["most_discussed", "pattern", "blind_spot"]
    assert cards[1].headline == "Not enough comments yet" and cards[2].evidence.startswith("Limited data") and "Q20" in cards[2].evidence
    schema = "category string, label string, headline string, detail string, question_ids array<string>, gap_id string, target_question_id string"
    one = spark.createDataFrame([("deployment", "In use", "H", "D", ["q3", "q20"], None, None)], schema)
    cards = stats.signal_cards(questions_of(spark), per_question, gaps, totals, one).collect()
    assert [c.category for c in cards] == ["most_discussed", "deployment", "blind_spot"]
    assert cards[1].target_question_id == "q3" and cards[1].evidence.startswith("Limited data")


M = "support_with_modification"


@pytest.mark.parametrize("per_question,totals,commenters,holds", [
    ([{M: 8, "mixed": 7}, {M: 3, "support": 2, "unclear": 1}, {M: 31}], {M: 40, "mixed": 7, "support": 2, "oppose": 4}, 9, True),
    ([{M: 8, "mixed": 8}, {M: 31}], {M: 38, "mixed": 8}, 9, False),            # a tie is no plurality
    ([{M: 6, "support": 5}], {M: 6, "support": 6}, 5, False),                  # half is not more than half
    ([{M: 18, "oppose": 1}], {M: 18, "oppose": 2}, 7, False),                  # a tenth is not rare
    ([{M: 19, "oppose": 1}], {M: 19, "oppose": 2}, 7, True),
    ([{M: 40}], {M: 40}, 4, False),                                            # too few commenters on every question
])
def test_pattern(spark, per_question, totals, commenters, holds):
    df = spark.createDataFrame(
        [(d, commenters >= 5) for d in per_question], "position_distribution map<string,bigint>, conclusion_eligible boolean"
    )
    counts = spark.createDataFrame(list(totals.items()), "stance string, n bigint")
    assert stats.docket_pattern(df, counts).first().holds is holds


def test_cost_of_a_stage_and_unpriced_model(spark):
    usage = "stage string, model string, " + ", ".join(f"{c} bigint" for c in stats.USAGE) + ", elapsed_seconds double"
    metrics = spark.createDataFrame([
        ("read", "small", 3, 0, 750_000, 40_000, 500_000, 100_000, 3.5), ("guess", "unlisted", 1, 1, 9, 9, 9, 9, 0.5),
    ], usage)
    prices = spark.createDataFrame([("small", 0.8, 4.0, 0.08, 1.0)], "model string, input double, output double, cache_read double, cache_write double")
    costs = {r.stage: r.estimated_cost_usd for r in stats.stage_costs(metrics, prices).collect()}
    assert costs == {"read": 0.9, "guess": None}  # 0.6 + 0.16 + 0.04 + 0.1
    assert stats.run_totals(stats.stage_costs(metrics, prices)).first().estimated_cost_usd == 0.9


IDENTITY = "comment_id string, organization string, display_name string, stakeholder_type string"


def test_commenters_merge_by_organization_only(spark):
    long = "The Very Long Name Of An Association For The Study Of Regulated Things"
    rows = [
        ("C-2", "Acme, Inc.", "Second name", "device_manufacturer"), ("C-1", "ACME inc", "", "device_manufacturer"),
        ("C-3", "Acme Inc", "", "individual"), ("C-4", "Acme Inc", "", "individual"), ("C-5", "", "", "other"),
        ("C-6", long + " East", "", "other"), ("C-7", long + " West", "", "other"),
    ]
    df = spark.createDataFrame(rows, IDENTITY)
    ids = {r.comment_id: r.id for r in df.select("comment_id", assemble.commenter_id().alias("id")).collect()}
    assert ids["C-1"] == ids["C-2"] == "c-acme-inc"
    assert len({ids[c] for c in ("C-3", "C-4", "C-5", "C-6", "C-7")}) == 5
    names = {r.commenter_id: r.display_name for r in assemble.commenters(df).collect()}
    assert names["c-acme-inc"] == "ACME inc" and names["c-c-5"] == "Individual commenter"


def test_organizations_of_any_script_stay_apart(spark):
    """Marks tell names apart; composed and decomposed spellings are one name."""
    names = ["कमल", "कमला", "कमली", "Société Générale", "Socie\u0301te\u0301 Ge\u0301ne\u0301rale", "東京大学", "東京大学院", "Ĺ", "L\u0301", "L"]
    df = spark.createDataFrame([(f"C-{i}", n, "", "other") for i, n in enumerate(names)], IDENTITY)
    ids = [r.id for r in df.select("comment_id", assemble.commenter_id().alias("id")).orderBy("comment_id").collect()]
    assert ids[3] == ids[4] and ids[7] == ids[8] and len(set(ids)) == 8
    assert all(len(i.rsplit("-", 1)[1]) == 16 for n, i in zip(names, ids) if not n.isascii())


def test_question_sets_keep_numeric_order(spark):
    df = spark.createDataFrame([(["q26", "q3", "q3", "q99", "x"],)], "q array<string>")
    assert df.select(vocab.mask_questions(vocab.question_mask(F.col("q"))).alias("q")).first().q == ["q3", "q26"]


def test_segments_number_long_comments_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(segments, "NUMBERING_RANGE", 10)
    n = 1005
    found = spark.range(n).select(
        F.lit("c").alias("comment_id"), F.col("id").alias("ord"), F.array(F.lit("q26"), F.lit("q3")).alias("question_ids"),
        F.concat(F.lit("a passage that is long enough to be kept, number "), F.col("id").cast("string")).alias("source_passage"),
        F.lit("gist").alias("position_gist"), F.lit(False).alias("is_background_only"),
    )
    again = found.withColumn("ord", F.col("ord") + n).withColumn("question_ids", F.array(F.lit("q7")))
    got = segments.segments(found.unionByName(again)).orderBy(F.length("segment_id"), "segment_id").collect()
    assert [r.segment_id for r in got] == [f"seg-{i:03d}" for i in range(1, n + 1)]
    assert got[-1].source_passage.endswith("1004") and got[0].question_ids == ["q3", "q7", "q26"]


def test_answers_are_parsed_or_marked(spark):
    df = spark.createDataFrame([(1, '```json\n{"a": 1}\n```'), (2, '{"a": 2}'), (3, '{"a": '), (4, None)], "i int, answer string")
    got = {r.i: (r.parsed.a if r.parsed else None, r.malformed) for r in labels.parse_answers(df, "struct<a:int>").collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (None, True), 4: (None, True)}


def test_scorer_runs_over_pending_rows(spark):
    def scorer(batch):
        return pd.DataFrame({"comment_id": batch.comment_id, "answer": batch.text.str.upper()})

    df = spark.createDataFrame([("c1", "a"), ("c2", "b")], "comment_id string, text string")
    assert {tuple(r) for r in labels.label_rows(df, scorer, "comment_id string, answer string", tasks=2).collect()} == {
        ("c1", "A"), ("c2", "B")
    }


def test_freshness_needs_all_versions(spark):
    inputs = spark.createDataFrame([("c1", "h"), ("c2", "other"), ("c3", "h")], "comment_id string, input_hash string")
    stored = spark.createDataFrame(
        [("c1", "h", "1", "2026", None), ("c2", "h", "1", "2026", None)],
        "comment_id string, input_hash string, prompt_version string, processing_version string, model string",
    )
    flagged = freshness.with_freshness(inputs, stored, "1", "2026")
    assert {r.comment_id: r.fresh for r in flagged.collect()} == {"c1": True, "c2": False, "c3": False}
    assert [r.comment_id for r in freshness.pending(flagged, limit=1).collect()] == ["c2"]
    assert not any(r.fresh for r in freshness.with_freshness(inputs, stored, "1", "2026", "m").collect())


# --- changes ----------------------------------------------------------------

def state(spark, saying="Speakers want staged rules.", exists=False, about=("definitions",), status="generated", kind="implementation_issue", divide=False):
    return spark.createDataFrame(
        [("q19", kind, exists, list(about), divide, saying, status)],
        "question_id string, dominant_response_type string, disagreement_exists boolean, disagreement_about array<string>, "
        "stakeholder_divide_exists boolean, saying string, synthesis_status string",
    )


def reasons(spark, prior, new):
    got = changes.compare_snapshots(prior, new).filter("question_id = 'q19'").first()
    return [r.reason for r in got.reasons]


def test_only_material_changes_are_queued(spark):
    base = [row("w1", "ada", q="q19"), row("w2", "bo", "evidence_suggestion", q="q19"), row("w3", "cy", issue="benchmarking", q="q19")]
    asked = questions_of(spark)

    def snap(extra=(), synthesis=None, less=0):
        return changes.snapshot(rows_of(spark, base[less:] + list(extra)), asked, synthesis)

    prior = snap(synthesis=state(spark))
    # More of the same, or less of it, is not material.
    assert reasons(spark, prior, snap([row("w4", "di", q="q19"), row("w5", "di", "evidence_suggestion", q="q19")], state(spark))) == []
    assert reasons(spark, prior, snap(less=1, synthesis=state(spark))) == []
    fresh = snap([row("w6", "ed", "concern", "trade_association", q="q19")], state(spark, "Nobody sees any need to move; the present text is enough for all."))
    assert reasons(spark, prior, fresh) == ["new_stakeholder_group", "new_substantive_position", "synthesis_changed"]
    many = snap([row(f"x{i}", f"z{i}", issue="benchmarking", q="q19") for i in range(4)], state(spark, kind="concern", divide=True))
    assert reasons(spark, prior, many) == ["dominant_response_type_changed", "stakeholder_divide_changed", "issue_crossed_threshold"]
    split = snap(synthesis=state(spark, exists=True, about=["timing"], status="stale"))
    assert reasons(spark, prior, split) == ["disagreement_emerged", "synthesis_stale"] and reasons(spark, split, prior) == ["disagreement_resolved"]
    assert reasons(spark, snap(), split) == []
    queue = changes.review_queue(prior, fresh).collect()
    assert [(q.question_id, q.prior_distinct_commenters, q.new_distinct_commenters) for q in queue] == [("q19", 3, 4)]
    untyped = changes.snapshot(rows_of(spark, [row("w1", "ada", None, q="q19")]), asked, state(spark))
    typed = changes.snapshot(rows_of(spark, [row("w1", "ada", "concern", q="q19")]), asked, state(spark))
    assert reasons(spark, untyped, typed) == []


# --- guards -----------------------------------------------------------------
CLAIM = (
    "question_id string, saying string, dominant_response_type string, "
    "disagreement struct<exists:boolean,about:array<string>,text:string,sides:array<struct<summary:string,position_ids:array<string>>>>, "
    "stakeholder_divide struct<claimed:boolean,groups:array<string>,text:string>, evidence_position_ids array<string>"
)
# Two patient groups, two insurers' investors and a lone engineer; "gil" speaks twice.
VOICES = [
    row("v01", "gil", "concern", "patient_consumer_group"), row("v02", "hana", "evidence_suggestion", "patient_consumer_group"),
    row("v03", "ivo", "no_clear_answer", "investor_vc"), row("v04", "jun", "concern", "investor_vc"),
    row("v05", "gil", "implementation_issue", "patient_consumer_group"), row("v06", "kay", "concern", "individual"),
]
CHORUS = [row("v07", "lu", group="investor_vc"), row("v08", "mo", group="patient_consumer_group")]


def guarded(spark, sides, rows, evidence=(), saying="Timing worries many.", groups=("patient_consumer_group", "investor_vc")):
    claim = ("q14", saying, "concern", (True, ["timing", "no-topic"], "Views part on timing.", [(f"side {i}", list(ids)) for i, ids in enumerate(sides)]),
             (True, list(groups), "Patients and investors."), list(evidence))
    return guards.guard(spark.createDataFrame([claim], CLAIM), rows_of(spark, rows)).first()


def test_sides_held_by_one_voice_do_not_disagree(spark):
    """The second side's only voice is also on the first."""
    out = guarded(spark, [["v02", "v05"], ["v01"]], VOICES, evidence=["nowhere", "v03"])
    assert not out.disagreement.exists and not out.disagreement.sides and out.disagreement.text.startswith("No material disagreement")
    assert not out.stakeholder_divide.exists and out.stakeholder_divide.note
    assert out.downgrades == ["disagreement_unsupported", "stakeholder_divide_unsupported", "evidence_filled"]
    # What is filled in prefers positions that answer, in id order; unknown ids are gone.
    assert out.evidence_position_ids == ["v03", "v01", "v02"]
    assert out.response_type_distribution.by_distinct_commenters == {"evidence_suggestion": 1, "concern": 3, "implementation_issue": 1, "no_clear_answer": 1}


def test_a_divide_needs_numbers_on_both_sides(spark):
    few = guarded(spark, [["v01", "v02"], ["v03"]], VOICES + CHORUS, evidence=["v06", "v02", "v08"])
    assert few.disagreement.exists and few.disagreement.about == ["timing"] and not few.stakeholder_divide.exists
    assert few.evidence_position_ids == ["v06", "v02", "v08", "v03"]
    both = guarded(spark, [["v05", "v02"], ["v03", "v07", "lost"]], VOICES + CHORUS, saying="Four short words here. " * 17)
    assert both.stakeholder_divide.exists and both.stakeholder_divide.groups == ["patient_consumer_group", "investor_vc"]
    assert [s.position_ids for s in both.disagreement.sides] == [["v05", "v02"], ["v03", "v07"]]
    assert len(both.saying.split()) == 60 and both.quality_flags == ["saying_cut_at_sentence"]
    apart = guarded(spark, [["v05", "v02"], ["v03", "v07"]], VOICES + CHORUS, groups=("patient_consumer_group", "individual"))
    assert apart.disagreement.exists and not apart.stakeholder_divide.exists


def test_one_sided_evidence_still_covers_the_other_side():
    given = [(f"p{i}", "c1") for i in range(5)]
    sides = [[("p0", "c1")], [("p9", "c2")]]
    chosen, filled = guards.choose(given, sides, [("p9", "c2")], 2)
    assert chosen == ["p0", "p1", "p2", "p3", "p9"] and not filled
    chosen, filled = guards.choose(given, [], [("p0", "c1"), ("p9", "c2")], 2)
    assert chosen == ["p0", "p1", "p2", "p3", "p9"] and filled
    assert guards.choose([], [], [("p1", "c1")], 1) == (["p1"], True)


def test_fingerprint_ignores_order_and_sees_every_change(spark):
    def of(rows, asked=questions_of(spark)):
        return guards.input_fingerprint(rows_of(spark, rows), asked).first().input_hash

    whole = of(VOICES)
    assert whole == of(VOICES[::-1]) and whole != of(VOICES[:-1])
    assert whole != of(VOICES[:-1] + [row("v06", "kay", None, "individual")])
    # The last voice merged into another commenter: the same words, another hash.
    assert whole != of(VOICES[:-1] + [(*VOICES[-1][:2], "jun", *VOICES[-1][3:])])
    reworded = questions_of(spark).withColumn("short_title", F.concat("short_title", F.lit("?")))
    assert whole != of(VOICES, reworded)


# --- comparison, search, rules ----------------------------------------------

def test_dominant_shift_rules(spark):
    pairs = spark.createDataFrame(
        [("c1", "s1", "concern", "concern", ["q1"]), ("c2", "s1", "recommendation", "concern", ["q1"])],
        "comment_id string, segment_id string, production string, shadow string, question_ids array<string>",
    )
    got = compare.dominant_shift(pairs).first()
    assert (got.production, got.shadow, got.changes) == ("recommendation", "concern", True)
    got = compare.dominant_shift(pairs, greatest_name=True).first()
    assert (got.production, got.production_n) == ("recommendation", 1)
    assert compare.agreement(pairs).first().agreement == 0.5


def test_page_parameters():
    got = facets.facets_from(view="tensions", theme="premarket", stakeholder="ai-companies", position="modify", search="x" * 200)
    assert got == facets.Facets("tensions", "premarket", "foundation_model_ai_platform", "support_with_modification", "x" * 120)
    assert facets.facets_from(view="no", theme="no", position="no") == facets.Facets()
    assert facets.facets_from(**facets.parameters_of(got)) == got
    assert facets.requested_question("#q26") == 26 and facets.requested_question("27") is None


def test_filters_relax_until_a_question_shows(spark):
    linked = spark.createDataFrame([
        ("p1", "c1", "Org", "individual", "", ["q7"], "support", "org"), ("p2", "c2", "Org", "other", "", ["q1"], "oppose", "org 100%"),
    ], "position_id string, commenter_id string, display_name string, stakeholder_type string, organization string, "
       "question_ids array<string>, position string, haystack string")
    asked = questions_of(spark)
    start = facets.Facets(view="tensions", theme="risk", stance="oppose")
    assert facets.relax_for(linked, asked, start, "q7") == facets.Facets()
    kept = facets.Facets(stance="support")
    assert facets.relax_for(linked, asked, kept, "q7") == kept
    literal = facets.Facets(search="100%")
    assert [r.position_id for r in facets.facet_filter(linked, asked, literal).collect()] == ["p2"]
    assert [r.question_id for r in facets.facet_filter(linked, asked, facets.Facets(search="title q7")).collect()] == ["q7"]


def test_forbidden_fields_are_found_at_any_depth(spark):
    df = spark.createDataFrame([], "a string, b struct<c:array<struct<reviewer:string>>>, model_confidence string")
    found = {r.entity_id for r in validate.forbidden_fields(spark, {"positions": df, "other": df}).collect()}
    assert found == {".b.c[].reviewer", ".model_confidence"}


def test_curated_rules(spark):
    takeaways = spark.createDataFrame([("t1", "T", "Text", ["q99"])], "id string, title string, text string, question_ids array<string>")
    lenses = spark.createDataFrame([("l1", "R", "Q", ["a"])], "id string, role string, question string, themes array<string>")
    blocks = spark.createDataFrame(
        [("q1", ["alignment", "odd"], "", ["g"])],
        "question_id string, read_fields array<string>, tension_synthesis string, tension_groups array<string>",
    )
    found = {r.rule for r in validate.curated_rules(takeaways, lenses, blocks).collect()}
    assert found == {"takeaway_count", "takeaway_questions_valid", "lens_count", "lens_complete", "curated_fields_known",
                     "curated_tension_complete"}
