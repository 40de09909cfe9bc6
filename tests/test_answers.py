"""Answers against their schemas; joins with hot keys."""
import copy
import json

import pytest
from pyspark.sql import functions as F

from colloquy.functions import answers
from colloquy.operators import assemble, facets, skew

GOOD = {
    "saying": "Many ask for time.", "dominant_response_type": "concern",
    "disagreement": {"exists": True, "about": ["timing"], "text": "Two views.", "sides": [
        {"summary": "one", "position_ids": ["p1"]}, {"summary": "other", "position_ids": []}]},
    "stakeholder_divide": {"claimed": False, "groups": [], "text": ""}, "evidence_position_ids": ["p1"],
}


def found(spark, texts, schema):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, answer string")
    return {r.i: [tuple(v) for v in r.v] for r in df.select("i", answers.violations(F.col("answer"), schema).alias("v")).collect()}


def test_departures_are_named_by_path(spark):
    bad = copy.deepcopy(GOOD)
    del bad["saying"]
    bad["dominant_response_type"] = ["concern"]
    bad["disagreement"]["about"] = ["timing", "weather"]
    bad["disagreement"]["sides"][1] = {"summary": 5, "position_ids": [None, 7], "more": {"x": 1}}
    bad["stakeholder_divide"], bad["extra"] = None, [1]
    got = found(spark, [json.dumps(GOOD), json.dumps(bad), "```json\n" + json.dumps(GOOD) + "\n```", '{"saying": ', None, "[]", "{}"], answers.SYNTHESIS)
    assert got[0] == got[2] == []
    assert got[1] == [
        ("$.saying", None, "missing"), ("$.dominant_response_type", '["concern"]', "wrong_type"),
        ("$.disagreement.about[1]", "weather", "not_listed"), ("$.disagreement.sides[1].summary", "5", "wrong_type"),
        ("$.disagreement.sides[1].position_ids[0]", None, "null"), ("$.disagreement.sides[1].position_ids[1]", "7", "wrong_type"),
        ("$.disagreement.sides[1].more", '{"x":1}', "not_declared"), ("$.stakeholder_divide", None, "null"), ("$.extra", "[1]", "not_declared")]
    assert got[3] == [("$", '{"saying":', "not_json")] and got[4] == [("$", "", "not_json")] and got[5] == [("$", "[]", "wrong_type")]
    assert [v[2] for v in got[6]] == ["missing"] * 5


@pytest.mark.parametrize("schema,good,bad,rules", [
    (answers.SEGMENTS, {"positions": [{"question_ids": ["q3"], "source_passage": "a", "position_gist": "b", "is_background_only": False}]},
     {"positions": [{"question_ids": ["q0", "q26"], "source_passage": "a", "position_gist": "b", "is_background_only": "no"}]},
     [("$.positions[0].question_ids[0]", "not_listed"), ("$.positions[0].is_background_only", "wrong_type")]),
    (answers.RESPONSE_TYPES, {"positions": []}, {"positions": [{"segment_id": "s", "response_type": "unknown"}, 3]},
     [("$.positions[0].response_type", "not_listed"), ("$.positions[1]", "wrong_type")]),
    (answers.COMMENTER, {"display_name": "", "organization": "", "stakeholder_type": "any", "source_identity_text": "", "confidence": "low"},
     {"display_name": "", "organization": None, "stakeholder_type": "any", "source_identity_text": "", "confidence": "sure"},
     [("$.organization", "null"), ("$.confidence", "not_listed")]),
    (answers.ANALYSIS, {"question_ids": [], "position": "mixed", "primary_issue": "x", "secondary_issue": None, "stakeholder_concern": "", "requested_fda_action": "",
                        "confidence": "high", "gap_tags": ["operational_harm"], "gap_explanations": [{"gap": "operational_harm", "explanation": ""}], "public_summary": ""},
     {"question_ids": [], "position": "maybe", "primary_issue": "x", "secondary_issue": 4, "stakeholder_concern": "", "requested_fda_action": "",
      "confidence": "high", "gap_tags": "operational_harm", "gap_explanations": [{"gap": "odd", "explanation": ""}], "public_summary": ""},
     [("$.position", "not_listed"), ("$.secondary_issue", "wrong_type"), ("$.gap_tags", "wrong_type"), ("$.gap_explanations[0].gap", "not_listed")]),
])
def test_every_schema_knows_its_lists(spark, schema, good, bad, rules):
    got = found(spark, [json.dumps(good), json.dumps(bad)], schema)
    assert got[0] == [] and [(path, rule) for path, _, rule in got[1]] == rules


def test_a_hot_key_is_spread_and_joined_whole(spark):
    """Seven tenths of the rows hold one key; no task gets more than a fifth of them."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        subs = spark.range(4000).selectExpr("concat('s', id) AS submission_id", "CASE WHEN id % 10 < 7 THEN 'c0' WHEN id % 10 = 7 THEN NULL ELSE concat('c', id % 300) END AS commenter_id")
        authors = spark.range(200).selectExpr("concat('c', id) AS commenter_id", "concat('name ', id) AS display_name")
        plain = assemble.authored_submissions(subs, authors)
        spread = skew.salted_join(subs, authors, "commenter_id", share=0.1, salts=16)
        assert spread.columns == plain.columns and sorted(map(tuple, spread.collect())) == sorted(map(tuple, plain.collect()))

        def largest(df):
            return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] / df.count()

        assert largest(plain) > 0.7 and largest(spread) < 0.2
        assert [r.commenter_id for r in skew.heavy_keys(subs, "commenter_id", 0.1).filter("commenter_id IS NOT NULL").collect()] == ["c0"]
        assert sorted(map(tuple, assemble.authored_submissions(subs, authors, 0.1).collect())) == sorted(map(tuple, plain.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_states_of_a_search_are_judged_in_one_scan(spark):
    from colloquy import vocab

    asked = vocab.questions_frame(spark).withColumns({"short_title": F.concat(F.lit("Topic "), "question_id"), "tags": F.array(F.lit("t")), "has_tension_block": F.col("question_number") != 5})
    rows = [(f"p{i}", f"c{i % 4}", kind, ["q5", "q20"] if i % 2 else ["q20"], "oppose" if i % 3 else "mixed", f"text {i}") for i, kind in enumerate(
        ["individual", "other", "investor_vc", "other", "individual", "other", "investor_vc", "other"])]
    positions = spark.createDataFrame(rows, "position_id string, commenter_id string, stakeholder_type string, question_ids array<string>, position string, haystack string")
    states = [facets.Facets(view=v, theme=t, stakeholder=k, stance=s, search=x) for v in ("questions", "tensions") for t in (None, "postmarket", "risk")
              for k in (None, "investor_vc") for s in (None, "mixed") for x in ("", "text 6", "topic q20")][::2]
    for question in ("q5", "q20", "q1"):
        one = asked.filter(F.col("question_id") == question)
        group = f"states {question}"
        spark.sparkContext.setJobGroup(group, "")
        got = facets.visibility(positions, asked, states, question)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        plans = [facets.view(positions, one, s) for s in states[::5]]
        assert got[::5] == [not p.isEmpty() for p in plans] and jobs <= 8  # two reads, a few stages each
